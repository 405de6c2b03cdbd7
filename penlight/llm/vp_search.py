"""Operator 3: approximate nearest neighbours by cosine with vantage-point trees per shard.

On unit vectors the Euclidean distance falls as the cosine rises, so the trees work on
those. A node has a vantage point and the ranges of distances from it to the points of
its two halves (split at the median); by the triangle inequality no point of a half is
nearer to a query than the query's own distance lies outside that range. A half is
skipped when this gap times `FACTOR` exceeds the k-th distance so far: factor 1 is exact
search, larger factors trade recall for work. The k-th value travels with the query from
its own shard to all others (see _vector_shards). Scores are exact cosines of the
original vectors in double precision.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths never meet; a tie goes to the
smaller id; a query with fewer than k candidates gets them all; a null id is no query and
no candidate; rows of one id are candidates of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penlight.llm._vector_shards import Best, search, usable

TOP, LEAF = 5, 128
FACTOR = 1.5
#: Rounding that neither bounds nor ties may suffer from.
SLACK = 1e-9


def lengths(points: np.ndarray) -> np.ndarray:
    return np.sqrt((points * points).sum(axis=1))


class VpTree:
    def __init__(self, ids: np.ndarray, points: np.ndarray, factor: float = FACTOR):
        self.ids, self.points, self.factor = ids, points, factor
        # Scaled first, so that squares of very large or small components stay finite.
        scaled = points / np.abs(points).max(axis=1, keepdims=True)
        self.norms = lengths(points)
        self.unit = scaled / lengths(scaled)[:, None]
        self.members, self.halves, self.vantage = [], [], []
        self.grow()

    def grow(self) -> None:
        """halves: of each node (child, least and largest distance from the vantage point)."""
        waiting = [(np.arange(len(self.ids)), -1, 0.0, 0.0)]
        while waiting:
            rows, parent, low, high = waiting.pop()
            at = len(self.members)
            if parent >= 0:
                self.halves[parent].append((at, low, high))
            self.members.append(rows)
            self.halves.append([])
            # The point farthest from the first one: near the rim, where distances spread.
            first = self.unit[rows] @ self.unit[rows[0]]
            self.vantage.append(rows[int(np.argmin(first))])
            if len(rows) <= LEAF:
                continue
            far = np.sqrt(np.maximum(2 - 2 * (self.unit[rows] @ self.unit[self.vantage[at]]), 0))
            order = np.argsort(far, kind="stable")
            if far[order[-1]] - far[order[0]] <= SLACK:
                continue  # copies of one vector
            self.members[at] = None
            half = len(rows) // 2
            for part in (order[:half], order[half:]):
                waiting.append((rows[part], at, float(far[part[0]]), float(far[part[-1]])))

    def cosines(self, rows: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        return (self.points[rows] * query).sum(axis=1) / (self.norms[rows] * norm)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray):
        """(query_id, vec_id, score) of the candidates found that reach the k-th score."""
        norms = lengths(queries)
        scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit = scaled / lengths(scaled)[:, None]
        away = np.sqrt(np.maximum(2 - 2 * (unit @ self.unit[self.vantage].T), 0))
        for i, query_id in enumerate(query_ids.tolist()):
            best, far = Best(TOP, bounds[i]), away[i].tolist()
            heap = [(0.0, 0)]
            reach = self.reach(best.worst)
            while heap:
                gap, node = heapq.heappop(heap)
                if gap * self.factor > reach:
                    break
                rows = self.members[node]
                if rows is None:
                    for child, low, high in self.halves[node]:
                        inner = max(gap, low - far[node], far[node] - high)
                        if inner * self.factor <= reach:
                            heapq.heappush(heap, (inner, child))
                    continue
                near = self.unit[rows] @ unit[i] >= best.worst - SLACK
                rows = rows[near & (self.ids[rows] != query_id)]
                if len(rows):
                    best.offer(self.cosines(rows, queries[i], norms[i]), self.ids[rows])
                    reach = self.reach(best.worst)
            for score, vec_id in best.rows:
                yield query_id, vec_id, -score

    @staticmethod
    def reach(score: float) -> float:
        return float(np.sqrt(max(2 - 2 * max(score, -1.0), 0))) + 1e-7


def vp_nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score: the TOP largest cosines found for each query."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(usable(F.col(vector_col)) & F.exists(F.col(vector_col), lambda x: x != 0) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return search(rows, is_query, TOP, lambda ids, points: VpTree(ids, points, factor).search, np.float64, -2.0)


def op3_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vp_nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
