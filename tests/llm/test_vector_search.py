"""Operators 2 and 3 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from penlight.llm import _vector_shards, kd_search, vp_search



def is_query():
    return F.col("vec_id") % 50 == 0


SCHEMA = "vec_id long, embedding array<float>, v int, score int, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 1, 2, "s") for i, x in rows], SCHEMA)


def brute(rows, value, k=5):
    good = [(i, np.array(x, dtype=np.float32).astype(float)) for i, x in rows if i is not None and x and None not in x and np.isfinite(np.array(x, dtype=np.float32)).all()]
    out = set()
    for q, x in good:
        if q % 50 == 0:
            found = sorted((-value(x, y), i) for i, y in good if i != q and len(y) == len(x) and value(x, y) is not None)
            out |= {(q, rank, i, round(-s, 9)) for rank, (s, i) in enumerate(found[:k], 1)}
    return out


def inner(x, y):
    return int((np.floor(256 * x) * np.floor(256 * y)).sum())


def cosine(x, y):
    a, b = np.sqrt((x * x).sum()), np.sqrt((y * y).sum())
    return None if not a or not b else float((x * y).sum() / (a * b))


def rows_of(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).round(2).tolist()) for i in range(n)]
    copy = rows[0][1]
    rows += [(n + i, copy) for i in range(60)]
    rows += [(5000, None), (5001, []), (5050, [None] * dim), (5100, [float("nan")] * dim), (5101, [float("inf")] + [0.0] * (dim - 1)), (5150, [0.0] * dim), (5200, [1.0, 2.0]), (5201, [2.0, 1.0]), (None, copy)]
    return rows


@pytest.mark.parametrize("small", [64, 4000])
def test_inner_products_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(_vector_shards, "SMALL", small)
    rows = rows_of(700, 6, 1)
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in kd_search.kd_top(table(spark, rows), is_query()).collect()}
    assert found == brute(rows, inner)


def test_factor_one_is_exact(spark, monkeypatch):
    monkeypatch.setattr(_vector_shards, "SMALL", 128)
    monkeypatch.setattr(_vector_shards, "BLOCK", 4)
    rows = rows_of(700, 6, 2)
    found = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in vp_search.vp_nearest(table(spark, rows), is_query(), factor=1.0).collect()}
    assert found == brute(rows, cosine)


def test_recall_and_pruning():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 16))
    ids = np.arange(4000)
    queries = points[::50]
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    cosines = unit[::50] @ unit.T
    cosines[np.arange(80), ids[::50]] = -9
    right = {(int(q), int(i)) for q, row in zip(ids[::50], cosines) for i in np.argsort(-row)[:5]}
    for factor, least in ((1.0, 1.0), (vp_search.FACTOR, 0.9)):
        tree = vp_search.VpTree(ids, points, factor)
        found = {(q, i) for q, i, _ in tree.search(ids[::50], queries, np.full(80, -2.0))}
        assert len(found & right) / len(right) >= least


def test_recall_on_the_given_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    right = {x[:3:2] for x in brute(rows, cosine)}
    found = {(r.query_id, r.vec_id) for r in vp_search.op3_vp_search(spark, "/root/testdata/sf0.01").collect()}
    assert len(found & right) >= 0.9 * len(right)


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [1.0, 0.0])]
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in kd_search.kd_top(table(spark, rows), is_query()).collect()}
    assert found == brute(rows, inner) and len(found) == 4
    empty = spark.createDataFrame([], SCHEMA)
    assert kd_search.kd_top(empty, is_query()).count() == 0 and vp_search.vp_nearest(empty, is_query()).count() == 0


def test_components_that_do_not_fit(spark):
    fine = table(spark, [(0, [2.0**22, 1.0]), (50, [-(2.0**22), 3.0])])
    assert {(r.query_id, r.score) for r in kd_search.kd_top(fine, is_query()).collect()} == {(0, -(2**60) + 768 * 256), (50, -(2**60) + 768 * 256)}
    with pytest.raises(Exception, match="too large"):
        kd_search.kd_top(table(spark, [(0, [1e10, 1e10]), (50, [1e10, -1.0])]), is_query()).collect()


def test_recall_over_several_shards(spark, monkeypatch):
    """At the query's own factor, over clustered vectors in several shards."""
    monkeypatch.setattr(_vector_shards, "SMALL", 200)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).round(4).tolist()) for i in range(2000)]
    expected = {(q, i) for q, _, i, _ in brute(rows, cosine)}
    found = {(r.query_id, r.vec_id) for r in vp_search.vp_nearest(table(spark, rows), is_query()).collect()}
    assert len(found) == len(expected) and len(found & expected) >= 0.95 * len(expected)
