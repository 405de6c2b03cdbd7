"""Operator 8: dealing documents into shards of near equal bytes by Karmarkar-Karp differencing.

Copies of a text form one group that no shard boundary may split. A partial partition
has one sum of bytes for each shard; differencing takes the two partial partitions with
the largest spread and adds them in opposite order, largest sum to smallest, until one
is left. Up to `BLOCK_GROUPS` groups are differenced as a whole. Beyond that the large
groups (above a `LARGE_PARTS`th of a shard, so some hundred) come first; then all hash
blocks but one, each a task, with its part of the bytes that the large ones have put into
the shards as a partial partition of its own, so that it evens them out; and then the
last block, with all that the shards hold by then. Only those sums reach the driver.

Law: `bytes` (sizes near equal, as far as the largest group allows: one that alone
exceeds an eighth of all bytes fills its shard).

Nulls and edges: a null text has size 1 and the checksum of no bytes, and all null texts
form one group apart from the empty ones; repeated rows are copies like any others; an
empty table gives an empty result; input columns that bear the name of an output column
are replaced.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penlight.llm._shared import written

SHARDS = 8
#: Groups in a block, on average, and what part of a shard's bytes makes a group large.
BLOCK_GROUPS, LARGE_PARTS = 100_000, 64
#: Documents in a bucket of the numbering, on average, and the least number of buckets of a shard.
SLOT_ROWS, LEAST_BUCKETS = 100_000, 32


def differenced(partitions: list[list[int]], shards: int) -> list[list[int]]:
    """The shard of every slot of every partial partition: out[i][k] for slot k of partition i.

    The sums of a partial partition are ascending. Joined partitions form a tree; a
    node keeps, for each of its own slots, the slot of either child, and a walk from
    the root hands the shards down.
    """
    if not partitions:
        return []
    nodes: list[tuple[int, int, list[int], list[int]]] = []
    heap = [(p[0] - p[-1], i) for i, p in enumerate(partitions)]
    heapq.heapify(heap)
    sums = dict(enumerate(partitions))
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        left, right = sums.pop(a), sums.pop(b)
        joined = [x + y for x, y in zip(left, reversed(right))]
        order = sorted(range(shards), key=joined.__getitem__)
        new = len(partitions) + len(nodes)
        nodes.append((a, b, order, [shards - 1 - k for k in order]))
        sums[new] = [joined[k] for k in order]
        heapq.heappush(heap, (sums[new][0] - sums[new][-1], new))
    out: dict[int, list[int]] = {heap[0][1]: list(range(shards))}
    for new in range(len(partitions) + len(nodes) - 1, len(partitions) - 1, -1):
        a, b, of_a, of_b = nodes[new - len(partitions)]
        at = out.pop(new)
        out[a], out[b] = [0] * shards, [0] * shards
        for slot in range(shards):
            out[a][of_a[slot]] = at[slot]
            out[b][of_b[slot]] = at[slot]
    return [out[i] for i in range(len(partitions))]


def dealt(shards: int, base: list[int]):
    """Deals the groups of a block into shards that already hold `base` bytes: what they hold is one partial partition among the groups."""
    order = sorted(range(shards), key=lambda k: (base[k], k))

    def difference(key: tuple, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "group"], ascending=[False, True], ignore_index=True)
        single = [[0] * (shards - 1) + [int(x)] for x in groups["bytes"]]
        found = differenced([*single, [base[k] for k in order]], shards)
        # The slot that a shard's bytes ended in is that shard.
        of_slot = dict(zip(found[-1], order))
        return pd.DataFrame({"group": groups["group"], "bytes": groups["bytes"], "shard": [of_slot[at[-1]] for at in found[:-1]]}).astype({"shard": "int32"})

    return difference


def shard_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """groups (group, bytes) with the shard of each."""
    n, total = groups.agg(F.count("*"), F.sum("bytes")).head()
    blocks = max(1, -(-n // BLOCK_GROUPS))
    rows = groups.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks)))
    schema = "group string, bytes long, shard int"

    def placed(some: DataFrame, base: list[int]) -> DataFrame:
        return written(some.groupBy("block").applyInPandas(dealt(shards, base), schema), "placed")

    def held(table: DataFrame) -> list[int]:
        by_shard = {r["shard"]: r["bytes"] for r in table.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
        return [by_shard.get(k, 0) for k in range(shards)]

    if blocks == 1:
        return placed(rows, [0] * shards)
    large = F.col("bytes") >= max(1, total // (shards * LARGE_PARTS))
    # At most shards * LARGE_PARTS groups.
    first = placed(rows.where(large).withColumn("block", F.lit(-1)), [0] * shards)
    # Every block evens out its part of what the large groups leave.
    second = placed(rows.where(~large & (F.col("block") > 0)), [x // (blocks - 1) for x in held(first)])
    done = first.unionByName(second)
    # And the last one what all together leave.
    return done.unionByName(placed(rows.where(~large & (F.col("block") == 0)), held(done)))


def numbered(rows: DataFrame, shard: str, order: str, n: int) -> DataFrame:
    """Adds slot: 0, 1, 2, ... in each shard. Each shard falls into buckets by the hash of `order`; counts of the buckets give every bucket its first slot."""
    buckets = max(LEAST_BUCKETS, n // SLOT_ROWS)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    run = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(shard, "_bucket").count()
    starts = counts.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("count").over(run), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(shard, "_bucket").orderBy(order)
    local = rows.withColumn("_i", F.row_number().over(inner))
    joined = local.join(starts.hint("merge"), (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_start") + F.col("_i") - 1).cast("long")).drop("_bucket", "_s", "_b", "_start", "_i")


def shard_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, shard and slot of every document."""
    text = F.col(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("group"),
    )
    sized = written(sized, "sized")
    groups = written(sized.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    placed = written(shard_groups(groups, shards).select(F.col("group").alias("_group"), "shard"), "placed")
    joined = written(sized.join(placed.hint("merge"), F.col("group") == F.col("_group")).drop("_group", "group"), "shards")
    return numbered(joined, "shard", "doc_id", joined.count())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_documents(docs).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
