"""Operators 4 and 8, and the pipeline, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from penlight.llm import bpe, mixing, quality_crf, sharding

TABLES = "/root/testdata/sf0.001"


def targets(sizes):
    """sizes by source; shares by weight, clamped at three times the size, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        free = total - sum(fixed.values())
        share = {s: free * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def mixed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    return docs, mixing.mix(docs).collect()


@pytest.mark.parametrize("scale", [1, 40])
def test_mix_meets_its_targets(spark, scale):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{'aab'[i % 3]}", "x") for i in range(60 * scale)]
    rows += [(1000 + i, "one two", "tiny", "x") for i in range(3)] + [(5000, None, None, "x"), (5001, "a b\x0bc", None, "x"), (5002, "", "none", "x"), (5003, "q", "é", "x"), (1, "twice", "sa", "x")]
    docs, found = mixed(spark, rows)
    assert len(found) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    right = targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(right[r.source])
    for s in sizes:
        assert abs(taken[s] - right[s]) <= 12, s
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, found))
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert copies == Counter({i: n for i, n in Counter({r.doc_id: 0 for r in found} | dict(sum((Counter({r.doc_id: r.repeats}) for r in found), Counter()))).items() if n})


def test_mix_of_nothing(spark):
    assert mixed(spark, [])[1] == []
    assert [r.taken for r in mixed(spark, [(1, None, "a", "x"), (2, "", None, "x")])[1]] == [0, 0]


def test_differencing_keeps_sums_and_is_tight():
    values = [8, 7, 6, 5, 4]
    slot = [at[-1] for at in sharding.differenced([[0, v] for v in values], 2)]
    sums = [sum(v for v, k in zip(values, slot) if k == s) for s in (0, 1)]
    assert sum(sums) == 30 and abs(sums[0] - sums[1]) == 2  # what differencing is known to give here
    many = [(i * 7919) % 1000 + 1 for i in range(3000)]
    slot = [at[-1] for at in sharding.differenced([[0] * 7 + [v] for v in many], 8)]
    sums = [sum(v for v, k in zip(many, slot) if k == s) for s in range(8)]
    assert max(sums) - min(sums) <= 2


def check_shards(rows, texts, slack):
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    size, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    text = dict(texts)
    for r in rows:
        data = (text[r.doc_id] or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    largest = max(sum(r.size for r in rows if text[r.doc_id] == t) for t in where)
    assert max(size.values()) - min(size.get(s, 0) for s in range(8)) <= max(largest, slack)


def test_shards_of_the_given_table(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()]
    rows = sharding.op8_sharding(spark, TABLES).collect()
    check_shards(rows, texts, 0)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)} and set(r.shard for r in rows) == set(range(8))


def test_shards_of_odd_rows(spark):
    texts = [(i, "copy of one text") for i in range(50)] + [(100 + i, f"text {i} " * (i % 9)) for i in range(90)] + [(300, None), (301, None), (302, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, shard string")
    check_shards(sharding.shard_documents(docs).collect(), texts, 40)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_pipeline_against_its_parts(spark):
    from tests.llm.test_ngram_join import brute

    frame = spark.read.parquet(f"{TABLES}/documents.parquet")
    docs = {r.doc_id: r for r in frame.collect()}
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").where("crc32(cast(doc_id as string)) % 4 <> 2")
    field = quality_crf.learn(frame, labels)
    good = [i for i, r in docs.items() if field.scores([r.text])[0] >= 0.7]
    kept = {i for i, _, c in brute([(i, docs[i].text) for i in good]) if i == c}
    found = corpus_pipeline.run(spark, TABLES).collect()
    assert {r.doc_id for r in found} <= kept
    at = frame
    for name, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, TABLES)
        assert at.columns == frame.columns, name
        if name == "n-gram Jaccard join":
            assert {r.doc_id for r in at.collect()} == kept
    assert sorted(map(tuple, found)) == sorted(map(tuple, bpe.digests(at).collect()))
    sizes = defaultdict(int)
    for i in kept:
        sizes[docs[i].source] += len(docs[i].text.split())
    assert len(found) >= len(kept) // 2 and set(sizes) == {docs[r.doc_id].source for r in found}


def spread(rows, shards=8):
    sizes = [0] * shards
    for r in rows:
        sizes[r.shard] += r.bytes
    return max(sizes) - min(sizes)


def test_one_block_is_differenced_as_a_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard_documents(docs).groupBy("shard").agg(sharding.F.sum("size").alias("bytes")).collect()
    sizes = {}
    for r in docs.collect():
        sizes[r.text] = sizes.get(r.text, 0) + len((r.text or "").encode()) + 1
    slots = sharding.differenced([[0] * 7 + [v] for v in sorted(sizes.values(), reverse=True)], 8)
    sums = [0] * 8
    for v, at in zip(sorted(sizes.values(), reverse=True), slots):
        sums[at[-1]] += v
    assert sorted(r.bytes for r in rows) == sorted(sums) and max(sums) - min(sums) <= 2


@pytest.mark.parametrize("block", [100_000, 60, 12])
def test_blocks_keep_the_balance(spark, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", block)
    rng = random.Random(3)
    sizes = [int(rng.paretovariate(1.1) * 50) for _ in range(600)]
    sizes += [max(sizes)] * 2
    rows = sharding.shard_groups(spark.createDataFrame([(f"g{i}", x) for i, x in enumerate(sizes)], "group string, bytes long")).collect()
    assert sorted(r.bytes for r in rows) == sorted(sizes) and len({r.group for r in rows}) == len(sizes)
    # Three groups have nearly a shard each, and still all shards come out near equal.
    assert 0.8 * sum(sizes) / 8 < max(sizes) < sum(sizes) / 8
    sums = [0] * 8
    ordered = sorted(sizes, reverse=True)
    for x, at in zip(ordered, sharding.differenced([[0] * 7 + [x] for x in ordered], 8)):
        sums[at[-1]] += x
    whole = max(sums) - min(sums)
    # The last block has about as many groups as `block` to even out with; a dozen cannot do much for eight shards.
    assert spread(rows) <= {100_000: whole, 60: whole + 50, 12: sum(sizes) // 64}[block]
