"""Operators 11, 12 and 13: brute force, exact numbers and held-out accuracy."""

import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from penlight.llm import lexical_search, toxicity, whitening

TABLES = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def terms(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    pooled = {}
    for item, text in dict.fromkeys(items):
        pooled.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, asked in pooled.items():
        scores = []
        for i, c in counted:
            n = sum(c.values())
            m = 75 + (25 * n * n_docs) // max(n_terms, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if s:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, score int")
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(map(tuple, lexical_search.search(d, q, **more).collect()), key=repr)


@pytest.mark.parametrize(("shard", "step", "block"), [(3_000_000, 4_000_000, 1_000_000), (60, 20, 1_000_000), (200, 4_000_000, 9)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, shard, step, block):
    for name, value in (("SHARD", shard), ("STEP", step), ("BLOCK", block)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)] + ["Ä", "中文", "X9"]
    weights = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ,".join(rng.choice(words, n, p=weights / weights.sum()))
    docs = [(i, text(int(rng.integers(1, 30)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(40)] + [(7, docs[7][1]), (None, docs[7][1]), (900, None), (901, ""), (902, "--\x00 !"), (903, "w1 " * 3000)]
    items = [(i, text(int(rng.integers(1, 12)))) for i in range(12)] + [(50, docs[7][1]), (50, docs[7][1]), (50, "ä W1"), (51, None), (52, "nowhere"), (None, "w3 w4")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, k=3) == brute(docs, items, 3)


def test_lexical_search_of_nothing(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []


def test_lexical_search_equals_its_sql(spark):
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    assert sorted(map(tuple, lexical_search.op11_lexical_search(spark, SMALL).collect())) == sorted(c.execute(lexical_search.OP11_SQL).fetchall())


def test_few_accumulators_are_made(spark):
    """After the rare term nothing that only has the common one gets an accumulator."""
    shard = lexical_search.Shard({b"common": 0, b"rare": 1})
    for i in range(400):
        shard.add(i, b"common" if i % 40 else b"rare common")
    items = lexical_search.Items([(1, "rare", 1), (1, "common", 1)])
    items.weigh(400, 410, {0: 400, 1: 10})
    lists = lexical_search.Lists(shard, items)
    places, _ = lists.best(items.order[1], 1, 5)
    assert set(places) == set(range(0, 400, 40)) and (lists.scores > 0).sum() == 10


def symmetric(n, values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "a",
    [np.array([[2.0]]), symmetric(2, [3, 1]), symmetric(40, range(40)), symmetric(40, [5] * 20 + [1] * 20), symmetric(40, [1] * 30 + [0] * 10), symmetric(30, 10.0 ** -np.arange(30)), np.ones((20, 20)), np.eye(9) * 3, np.zeros((5, 5)), np.diag([1.0, 1, 1, 2, 2, 3]), symmetric(40, 3 + 1e-14 * np.arange(40)), symmetric(41, np.arange(-20.0, 21))],
)
def test_components_of_a_symmetric_matrix(a):
    values, vectors = whitening.components((a + a.T) / 2)
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh((a + a.T) / 2)[::-1]).max() <= 1e-13 * size * len(a)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size * len(a) and np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13


def test_polar_factor_is_the_sign():
    a = symmetric(12, [4, 3, 2, 1, 0.5, 1e-6, -1e-6, -1, -2, -3, -4, -5])
    values, q = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - q @ np.diag(np.sign(values)) @ q.T).max() < 1e-9


def test_whitening_numbers(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5))
    v[:, 4] = 0.25
    rows = [(i, [float(x) for x in r], i, 1.0) for i, r in enumerate(v)] + [(0, [float(x) for x in v[0]], 0, 1.0), (None, [float(x) for x in v[1]], 0, 1.0)]
    odd = [(900, None, 0, 0.0), (901, [], 0, 0.0), (902, [None] * 5, 0, 0.0), (903, [float("nan")] * 5, 0, 0.0), (904, [float("inf")] * 5, 0, 0.0), (905, [1.0], 0, 0.0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, deviation int, whitened double")
    fit = whitening.learn(df)
    got = whitening.whitened(df, fit).collect()
    x = np.floor(64 * np.array([r[1] for r in rows])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert fit.n == n and fit.kept.tolist() == [True] * 4 + [False]
    assert np.allclose(fit.explained[:4], values[:4] / values.sum(), rtol=1e-12)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    for i, row in zip([r[0] for r in rows], x):
        mine = by_id[i][0]
        assert mine.deviation == int(((n * row - sums).astype(object) ** 2).sum()) and mine.whitened[4] is None
        assert np.allclose(np.abs(mine.whitened[:4]), np.abs((row - sums / n) @ vectors[:, :4] / np.sqrt(values[:4])), atol=1e-9)
    assert len(got) == n and whitening.identity_error(whitening.whitened(df, fit), fit) < 1e-10


def test_whitening_of_large_entries(spark):
    rows = [(1, [2.0**42, 1.0]), (2, [-(2.0**42), 2.0]), (3, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fit = whitening.learn(df)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    third = sum((3 * a - b) ** 2 for a, b in zip(x[2], s))
    assert {r.vec_id: r.deviation for r in whitening.whitened(df, fit).collect()} == {1: None, 2: None, 3: third}
    exact = [[sum((3 * r[i] - s[i]) * (3 * r[j] - s[j]) for r in x) / 27 for j in (0, 1)] for i in (0, 1)]
    assert np.allclose(fit.values, np.linalg.eigvalsh(np.array(exact))[::-1], rtol=1e-12)
    with pytest.raises(Exception, match="2\\*\\*43"):
        whitening.learn(spark.createDataFrame([(1, [2.0**44])], df.schema))


def test_whitening_query(spark, tmp_path):
    rows = whitening.op12_whitening(spark, SMALL).toPandas()
    w = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert w.shape[1] == 32 and np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-9 and rows.identity_error.max() < 1e-9
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert whitening.op12_whitening(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/same/embeddings.parquet")
    same = whitening.op12_whitening(spark, f"{tmp_path}/same").collect()
    assert len(same) == 4 and all(r.deviation == 0 and r.whitened is r.explained is r.identity_error is None for r in same)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    rows = toxicity.op13_toxicity(spark, TABLES).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == held(r.doc_id) for r in rows)
    tested = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    # With some 40 toxic documents to learn from, rare words stay unknown; on larger tables nearly all are caught.
    assert sum(r.predicted == labels[r.doc_id] for r in tested) >= 0.92 * len(tested)
    assert not any(r.predicted for r in tested if not labels[r.doc_id])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="larger tables are not there")
def test_toxicity_on_more_documents(spark):
    """Learned from some thousand documents, with large groups of copies among them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/check_s/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels.where(~toxicity.held_out()))
    some = labels.where(toxicity.held_out() & toxicity.F.col("toxic").isNotNull()).join(docs, "doc_id")
    rows = toxicity.scored(some, model).select("toxic", "predicted").collect()
    bad = [r.predicted for r in rows if r.toxic]
    good = [r.predicted for r in rows if not r.toxic]
    assert sum(bad) >= 0.97 * len(bad) and sum(good) <= 0.01 * len(good)


def lengths_by_hand(window, content):
    """The same setting, by a compressor without a prepared dictionary."""
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(window_log=18, chain_log=18, hash_log=18, search_log=6, min_match=6, target_length=0, strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=0, write_content_size=0, write_dict_id=0)
    return zstandard.ZstdDecompressor(dict_data=d).decompress(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(toxicity.coded(window)), max_output_size=10_000)


def sample():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeioustrln"), 6)) for _ in range(400)]
    bad = ["zzbrakka", "qwuxxlo", "vyfjjkk"]
    texts, labels = [], []
    for i in range(400):
        found = list(rng.choice(words, 60))
        if i % 5 == 0:
            found[int(rng.integers(0, 60))] = bad[i % 3]
        texts.append(" ".join(found))
        labels.append(int(i % 5 == 0))
    return texts, labels


def test_windows_tell_by_their_lengths(spark):
    texts, labels = sample()
    model = toxicity.fit(texts, labels)
    assert [w for w in ("zzbrakka", "qwuxxlo", "vyfjjkk") if model.is_toxic(w)] == ["zzbrakka", "qwuxxlo", "vyfjjkk"]
    for w in ("zzbrakka", "aeious", ""):
        assert lengths_by_hand(w, model.toxic) == toxicity.coded(w)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 -- 3", 1), (4, "x" * 100_000, 1), (5, "Zzbrakka, " + texts[1], 1), (6, texts[1] + " " + texts[2] * 200, 1), (5, "Zzbrakka, " + texts[1], 1)], "doc_id long, text string, score int")
    rows = sorted(toxicity.scored(odd, model).collect(), key=lambda r: r.doc_id)
    assert rows[0].score == rows[1].score == rows[2].score and [r.predicted for r in rows] == [0, 0, 0, 0, 1, 1, 0] and len(rows) == 7
    assert toxicity.scored(odd.limit(0), model).count() == 0


def test_copies_are_no_further_evidence():
    texts, labels = sample()
    copies = [(toxicity.windows(texts[0] + " copyword " + texts[0]), 1)] * 80
    docs = [(toxicity.windows(t), y) for t, y in zip(texts, labels)]
    assert "copyword" not in toxicity.telling(docs + copies) and "zzbrakka" in toxicity.telling(docs + copies)


def test_toxicity_with_little_to_learn_from():
    assert toxicity.fit([], []).scores(["x"]).tolist() == [0.5] and toxicity.fit(["a", None], [1, 1]).scores(["x"]).tolist() == [1.0]
    assert toxicity.fit(["a b", "a c", "a d", "a e"], [1, 0, 0, 0]).scores(["x", None]).tolist() == [0.25, 0.25]
