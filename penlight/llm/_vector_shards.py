"""What the two vector searches share: usable vectors, shards, two rounds, the merge.

Vectors are dealt into shards by the hash of their id; a task builds one tree for one
shard. In the first round the queries of a shard search that shard alone, which gives
each query a k-th best value; the second round sends every query with that value to all
other shards, so that their trees prune from the start. Queries travel in blocks of
bounded size, and a shard's vectors go along once for each block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penlight.llm._shared import written

#: Rows of a shard: at most about LARGE, and less where that would leave fewer than SHARDS shards, but not below SMALL.
LARGE, SHARDS, SMALL = 32_768, 48, 1_024
#: Queries of a block, on average.
BLOCK = 20_000
FOUND = "query_id long, vec_id long, score {kind}"

#: Builds a tree over the ids and vectors of a shard: a function of the queries' ids, vectors and k-th best values so far that yields (query_id, vec_id, score).
Searcher = Callable[[np.ndarray, np.ndarray], Callable]


def usable(v: Column) -> Column:
    """True for a vector with components, all of them finite."""
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & good, F.lit(False))


def matrix(vectors: pd.Series, kind) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=kind) for x in vectors])


def search(vectors: DataFrame, is_query: Column, k: int, build: Searcher, numbers, least: float) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best.

    vectors: vec_id and v (usable, not null). build(ids, vectors) makes a tree and
    returns its search; numbers: numpy type of components; least: a value below all scores.
    Rows of one id are candidates of their own for other queries; as a query an id stands
    once, with the smallest of its vectors.
    """
    out_kind = "long" if np.issubdtype(numbers, np.integer) else "double"
    n = vectors.count()
    shards = max(-(-n // LARGE), min(SHARDS, -(-n // SMALL)), 1)
    points = written(vectors.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.coalesce(is_query, F.lit(False)).alias("is_query")), "vectors")

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        asked = rows[rows["is_query"]].sort_values("v", key=lambda s: s.map(tuple)).drop_duplicates("vec_id")
        if not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        find = build(rows["vec_id"].to_numpy(), matrix(rows["v"], numbers))
        return answer(find, asked, np.full(len(asked), least))

    def others(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        find = build(rows["vec_id"].to_numpy(), matrix(rows["v"], numbers))
        return answer(find, asked, asked["bound"].to_numpy(dtype=float))

    def answer(find, asked: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        found = list(find(asked["vec_id"].to_numpy(), matrix(asked["v"], numbers), bounds))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    kind = FOUND.format(kind=out_kind)
    first = written(points.select("dim", "shard", "vec_id", "v", "is_query").groupBy("dim", "shard").applyInPandas(own, kind), "first")
    bound = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    queries = points.where("is_query").groupBy("vec_id", "dim", "shard").agg(F.min("v").alias("v"))
    queries = queries.join(bound.hint("merge"), F.col("vec_id") == F.col("query_id"), "left").drop("query_id").withColumn("bound", F.coalesce(F.col("bound").cast("double"), F.lit(least)))
    queries = written(queries.withColumnRenamed("shard", "home"), "queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
    offered = points.select("dim", "shard", "vec_id", "v").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    second = offered.groupBy(*keys).cogroup(asked.select(*keys, "vec_id", "v", "bound").groupBy(*keys)).applyInPandas(others, kind)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The k best (score, id) of one query: higher scores first, then smaller ids. worst: the value that a further candidate must reach."""

    def __init__(self, k: int, bound: float):
        self.k, self.rows, self.worst = k, [], bound

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.worst)
        if not len(good):
            return
        if len(good) > self.k:
            good = good[np.lexsort((ids[good], -scores[good]))[: self.k]]
        self.rows += [(-s, i) for s, i in zip(scores[good].tolist(), ids[good].tolist())]
        self.rows.sort()
        del self.rows[self.k :]
        if len(self.rows) == self.k:
            self.worst = max(self.worst, -self.rows[-1][0])
