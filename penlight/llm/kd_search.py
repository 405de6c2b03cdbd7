"""Operator 2: exact top-k by inner product with KD-trees per shard.

A tree splits its points at the median of the widest dimension and keeps the tight
bounding box of every node. No point of a box has a larger inner product with a query
than the box's corner on the query's side; nodes are visited best bound first, until the
best one left is below the k-th score found so far. That k-th score travels with the
query from its own shard to all others (see _vector_shards).

Nulls and edges: vectors that are null, empty or hold null or non-finite components take
no part; vectors of different lengths never meet; a tie goes to the smaller id; a query
with fewer than k candidates gets them all; a null id is no query and no candidate; rows
of one id are candidates of their own; an empty table gives an empty result. Components
are taken as 64-bit integers after scaling; a vector whose square of its largest component
times its length reaches 2**63 raises an error, since its scores might not fit.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penlight.llm._vector_shards import Best, search, usable

TOP, SCALE, LEAF = 5, 256, 256
LEAST = float("-inf")


class KdTree:
    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points
        self.low, self.high, self.children, self.members = [], [], [], []
        self.grow(np.arange(len(ids)))
        self.low, self.high = np.array(self.low, dtype=float), np.array(self.high, dtype=float)

    def grow(self, rows: np.ndarray) -> None:
        """Nodes in the order they are met; a node's members are None once it is split."""
        waiting = [(rows, -1)]
        while waiting:
            rows, parent = waiting.pop()
            at, box = len(self.members), self.points[rows]
            low, high = box.min(axis=0), box.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            self.members.append(rows)
            if parent >= 0:
                self.children[parent].append(at)
            wide = int(np.argmax(high - low))
            if len(rows) > LEAF and high[wide] > low[wide]:
                self.members[at] = None
                half = len(rows) // 2
                order = np.argpartition(box[:, wide], half)
                waiting += [(rows[order[:half]], at), (rows[order[half:]], at)]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray):
        """(query_id, vec_id, score) of the candidates that reach the k-th score."""
        q = queries.astype(float)
        reach = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        # Room for rounding where products exceed what doubles hold exactly.
        reach += np.abs(reach) * 1e-12
        for i, query_id in enumerate(query_ids.tolist()):
            best, bound, query = Best(TOP, bounds[i]), reach[i].tolist(), queries[i]
            heap = [(-bound[0], 0)]
            while heap:
                value, node = heapq.heappop(heap)
                if -value < best.worst:
                    break
                rows = self.members[node]
                if rows is None:
                    for child in self.children[node]:
                        if bound[child] >= best.worst:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                ids = self.ids[rows]
                other = ids != query_id
                if not other.all():
                    rows, ids = rows[other], ids[other]
                best.offer(self.points[rows] @ query, ids)
            for score, vec_id in best.rows:
                yield query_id, vec_id, -score


def integers(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def kd_top(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the TOP largest integer inner products of each query."""
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    v = F.col(vector_col)
    largest = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) * SCALE + 1
    fits = largest * largest * F.size(v) < 2.0**63
    whole = F.when(fits, integers(v)).otherwise(F.raise_error(F.lit("components too large for 64-bit scores")).cast("array<bigint>"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    return search(rows, is_query, TOP, lambda ids, points: KdTree(ids, points).search, np.int64, LEAST)


def op2_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
