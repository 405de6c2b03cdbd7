"""Operator 7 against all pairs on small tables."""

import random
import re

import numpy as np
import pyarrow as pa

from penlight.llm import ngram_join


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {(i, len(sets[i]), root(i)) for i in sets}


def outcome(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {tuple(r) for r in ngram_join.near_duplicates(docs).collect()}


def edited(rng, w, times):
    w = list(w)
    for _ in range(times):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return w


def test_groups_of_copies_match_all_pairs(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage = fresh(60)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One TWO"), (5, "one two three")]
    for base_no in range(6):
        base = fresh(rng.randrange(5, 150))
        for k in range(12):
            rows.append((len(rows) + 10, " ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 25)))))
    for _ in range(30):
        rows.append((len(rows) + 10, " ".join(fresh(rng.randrange(8, 25)) + passage + fresh(5))))
    rows += [(len(rows) + 100 + k, "same text over and over again and again") for k in range(40)]
    rng.shuffle(rows)
    assert outcome(spark, rows) == brute(rows)


def test_chains_reach_the_smallest_id(spark):
    w = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(w[4 * k : 4 * k + 200])) for k in range(40)]
    found = outcome(spark, rows)
    assert found == brute(rows) and len({x[2] for x in found}) == 1


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in ngram_join.op7_ngram_join(spark, "/root/testdata/sf0.001").collect()} == brute(rows)


def test_empty_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(docs).count() == 0
    text = "a b c d e f g h i j"
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (9, text), (None, None)], "doc_id long, text string")
    found = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, 6, None), (7, 6, 7), (7, 6, 7), (9, 6, 7), (None, 0, None)], key=str)
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs.where("doc_id > 0")).collect()) == [7]


def test_shared_rows_over_batches():
    rng = random.Random(1)
    rows = sorted((rng.randrange(30), rng.randrange(3), rng.randrange(50)) for _ in range(200))  # equal sizes and places: all may link
    expected = []
    for token in sorted({t for t, _, _ in rows}):
        classes = {}
        for t, c, d in rows:
            if t == token:
                classes.setdefault(c, d)
        if len(classes) > 1:
            expected += [(token, d) for _, d in sorted(classes.items())]
    for step in (1, 2, 7, 200):
        batches = []
        for at in range(0, len(rows), step):
            t, c, d = (np.array(x) for x in zip(*rows[at : at + step]))
            batches.append(pa.RecordBatch.from_arrays([pa.array(x) for x in (t, np.zeros(len(t), np.int32), c, d, np.full(len(t), 40, np.int32), np.zeros(len(t), np.int32))], names=["token", "salt", "c1", "doc_id", "n", "pos"]))
        got = [(r["token"], r["doc_id"]) for b in ngram_join.shared_rows(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted(expected)


def test_salted_rows_stay_and_do_not_disturb():
    rows = [(1, 0, 5, 50), (2, 3, 5, 50), (3, 0, 5, 50), (3, 0, 6, 60), (4, 9, 7, 70), (5, 0, 1, 10)]
    for step in (1, 2, 6):
        batches = []
        for at in range(0, len(rows), step):
            t, s, c, d = (np.array(x) for x in zip(*rows[at : at + step]))
            batches.append(pa.RecordBatch.from_arrays([pa.array(x) for x in (t, s.astype(np.int32), c, d, np.full(len(t), 40, np.int32), np.zeros(len(t), np.int32))], names=["token", "salt", "c1", "doc_id", "n", "pos"]))
        assert sorted((r["token"], r["doc_id"]) for b in ngram_join.shared_rows(iter(batches)) for r in b.to_pylist()) == [(2, 50), (3, 50), (3, 60), (4, 70)]


def test_sets_of_odd_texts():
    texts = [None, "", "a", "A b", "a b", "one two three four five", "One two  three\tfour five\u00a0x six", "x y z x y z x y z x y z", "", "é Ü ü"]
    tokens, at = ngram_join.shingle_sets(texts)
    sets = [set(tokens[at[k] : at[k + 1]].tolist()) for k in range(len(texts))]
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 1, 2, 3, 0, 1]
    assert sets[3] == sets[4] and sets[2] != sets[3] and not sets[5] & sets[6]
    again, bounds = ngram_join.shingle_sets(["so " * 3000, *texts])
    assert (again[bounds[1] :] == tokens).all()


def test_largest_id_links_where_all_holders_of_a_token_are_single(spark):
    rng = random.Random(8)
    # The star centre of a token is its holder of smallest hash: the linked pair never is one.
    hashed = spark.range(1, 400).selectExpr("id", "least(xxhash64(id, 0), xxhash64(id, 1)) low", "greatest(xxhash64(id, 0), xxhash64(id, 1)) high").collect()
    centres = [r.id for r in sorted(hashed, key=lambda r: r.high)[:24]]
    smaller, largest = sorted(r.id for r in hashed if r.low > max(h.high for h in hashed if h.id in centres) and r.id > max(centres))[-2:]
    parts = [[f"p{k}x{i}" for i in range(12)] for k in range(12)]
    whole = [w for p in parts for w in p]
    rows = [(smaller, " ".join(["one", *whole])), (largest, " ".join([*whole, "two"]))]
    for k, i in enumerate(centres):
        # Runs of six parts, so that every shingle but the pair's own ones has many holders.
        at = k % 12
        run = [w for j in range(at, at + 6) for w in parts[j % 12]]
        rows.append((i, " ".join([*run, *[f"own{i}x{j}" for j in range(50)]])))
    rng.shuffle(rows)
    expected = brute(rows)
    assert {(largest, smaller), (smaller, smaller)} <= {(i, c) for i, _, c in expected} and len({c for _, _, c in expected}) == len(rows) - 1
    assert outcome(spark, rows) == expected


def test_null_id_before_the_first_id_of_its_text(spark):
    text = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(text)), (7, " ".join(text)), (9, " ".join([*text, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, 56, None), (7, 56, 7), (9, 57, 7)], key=str)
