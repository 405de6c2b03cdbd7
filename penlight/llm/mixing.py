"""Operator 4: mixing sources to target weights by capped water-filling.

Every source has a weight and a size (words). Its target is its weight's share of all
words, but at most `max_epochs` times its size; what a clamped source cannot take is
shared out again by weight among the rest until no target is above its cap. A target
then becomes whole repetitions of every document of the source plus a fractional
repetition: the documents first in a seeded order, as many as come nearest to the rest.

Nulls and edges: a null text has size 0; a null source is a source of its own, last in
order; documents of size 0 are never in the way and take 0 words; repeated rows count
as rows of their own; an empty table gives an empty result; input columns that bear the
name of an output column (size, source_size, target, repeats, taken) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penlight.llm._shared import WORD_PATTERN, written

#: Weights that sources get in code-point order, over and over.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Up to so many sources the plan is sent to all tasks; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds a gapless rank by source, null last; range partitions keep it parallel."""
    parts = written(sizes.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").count().select(F.col("part").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    # At most eight rows on the right side.
    return parts.withColumn("i", F.row_number().over(inner)).join(F.broadcast(starts), F.col("part") == F.col("p")).select("source", "source_size", (F.col("start") + F.col("i") - 1).alias("rank"))


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """Words per unit of weight at which the capped targets add up to all words.

    sources: source_size and weight. Each round clamps what is above its cap at the
    present level and shares the rest again; the level only rises, and the rounds end
    when no further source is clamped. A round brings one row to the driver.
    """
    cap = F.col("source_size") * max_epochs
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).head()
    if not weights:
        return 0.0
    level, clamped = total / weights, 0
    while True:
        over = F.col("weight") * F.lit(level) > cap
        n, used, free = sources.agg(F.count_if(over), F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).head()
        if n == clamped or not free:
            return level
        level, clamped = (total - used) / free, n


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """docs with size, source_size, target, repeats (how often the mix takes the document) and taken (the words of those repetitions).

    Documents are dealt by hash into 4096 buckets of each source, so that only the one
    bucket in which a source's fraction ends is ever sorted; a hot source stays spread.
    """
    docs = docs.drop("size", "source_size", "target", "repeats", "taken")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = docs.withColumns({"size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long"), "_key": key}).withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    buckets = written(sized.groupBy(F.col(source_col).alias("source"), F.col("_bucket").alias("bucket")).agg(F.sum("size").alias("words")), "buckets")
    cycle = F.array(*[F.lit(w) for w in weights])
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = written(ranked_sources(sizes).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long")), "weighted")
    level = water_level(sources, max_epochs)
    target = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * max_epochs).cast("double"))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    plan = sources.withColumn("target", target).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(run), F.lit(0))
    levels = plan.select(F.col("source").alias("plan_source"), "rest")
    ends = buckets.withColumn("before", before).join(levels.hint("merge"), F.col("source").eqNullSafe(F.col("plan_source")))
    ends = ends.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")) & (F.col("rest") > 0))
    cut = ends.select(F.col("source").alias("cut_source"), F.col("bucket").alias("cut"), "before")
    plan = written(plan.join(cut.hint("merge"), F.col("source").eqNullSafe(F.col("cut_source")), "left").select(F.col("source").alias("_source"), "source_size", "target", F.col("whole").alias("_whole"), F.col("rest").alias("_rest"), F.col("cut").alias("_cut"), F.col("before").alias("_before")), "mix")
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = sized.join(F.broadcast(plan) if small else plan.hint("merge"), F.col(source_col).eqNullSafe(F.col("_source")))
    at_cut = (F.col("_bucket") == F.col("_cut")) & F.col("_cut").isNotNull()
    order = Window.partitionBy(source_col, "_bucket").orderBy("_key", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    # In the bucket of the cut, a document is taken if that brings the sum no further from the rest.
    near = 2 * (F.col("_before") + F.sum("size").over(order)) - F.col("size") <= 2 * F.col("_rest")
    edge = joined.where(at_cut).withColumn("_extra", near.cast("int"))
    others = joined.where(~F.coalesce(at_cut, F.lit(False))).withColumn("_extra", F.coalesce((F.col("_bucket") < F.col("_cut")).cast("int"), F.lit(0)))
    out = others.unionByName(edge).withColumn("repeats", (F.col("_whole") + F.col("_extra")).cast("long"))
    return out.withColumn("taken", F.col("repeats") * F.col("size")).select(*docs.columns, "size", "source_size", "target", "repeats", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as mix() takes it, with the columns of docs."""
    return mix(docs, **options).withColumn("_copy", F.explode(F.expr("array_repeat(1, cast(repeats as int))"))).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w
  FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, w, source NULLS LAST) AS k FROM s),
c AS (
  SELECT *, (SELECT sum(size) FROM d)::BIGINT - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS free,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS ws
  FROM r),
lvl AS (SELECT free::DOUBLE / ws::DOUBLE AS level FROM c WHERE w * (free::DOUBLE / ws::DOUBLE) <= 3 * source_size ORDER BY k LIMIT 1),
p AS (
  SELECT source, source_size, least(w * (SELECT level FROM lvl), (3 * source_size)::DOUBLE) AS target FROM s),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM p),
t AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS cum
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND 2 * cum - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM t
"""
