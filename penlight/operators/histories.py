"""Long histories of one entity in bounded parts.

An entity's rows fall into buckets of time, and a bucket is what a task holds. What a row
needs from beyond its bucket comes in one of two ways. A bounded frame takes halo rows:
copies of the rows of the buckets nearby that the frame may reach. An unbounded one takes a
carry: every bucket is summed up in a row, those rows are scanned in order, a few for each
entity, and the result goes back to the rows of the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
#: Days of a bucket, and rows of a run of numbered rows.
BUCKET_DAYS, RUN_ROWS = 30, 100_000
#: Width of the parts of a history in the order of a number, such as the frames of a video.
ORDER_STEP = 10_000
#: The bucket of rows without a time: they sort first.
NO_TIME = -(2**31)
TIMES = ("timestamp", "timestamp_ntz", "date")


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def bucket_of(at: Column) -> Column:
    """The bucket of a time in microseconds."""
    return F.coalesce(F.floor(at / F.lit(BUCKET_DAYS * DAY_MICROS)).cast("int"), F.lit(NO_TIME))


def bucketed(df: DataFrame, keys: Sequence[str], time: str, back: int = 0) -> DataFrame:
    """df with _bucket, and _own: false for copies of rows that lie at most `back` microseconds before a later bucket. A column that holds no time has one bucket."""
    if dict(df.dtypes)[time] not in TIMES:
        return df.withColumns({"_bucket": F.lit(0), "_own": F.lit(True)})
    at = micros(time)
    mine = bucket_of(at)
    if not back:
        return df.withColumns({"_bucket": mine, "_own": F.lit(True)})
    reached = F.when(at.isNotNull(), F.sequence(mine, bucket_of(at + back))).otherwise(F.array(mine))
    return df.withColumn("_bucket", F.explode(reached)).withColumn("_own", F.col("_bucket") == mine)


def attached(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of small, which has a row for each key and _bucket."""
    group = [*keys, "_bucket"]
    named = small.select(*[F.col(c).alias(f"_of_{c}") for c in group], *[c for c in small.columns if c not in group])
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    return rows.join(named.hint("merge"), on, "left").drop(*[f"_of_{c}" for c in group])


def over_buckets(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("_bucket")


def before_bucket(column: Column, how, keys: Sequence[str]) -> Column:
    """An aggregate over all buckets of the entity before this one."""
    return how(column).over(over_buckets(keys).rowsBetween(Window.unboundedPreceding, -1))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the place of each row in its entity's order, from 0."""
    rows = bucketed(df, keys, order[0]).drop("_own")
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select(*keys, "_bucket", F.coalesce(before_bucket(F.col("_n"), F.sum, keys), F.lit(0)).alias("_start"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    return attached(local, starts, keys).withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_bucket", "_local", "_start")


def in_runs(df: DataFrame, keys: Sequence[str], time: str, ahead: int) -> tuple[DataFrame, WindowSpec]:
    """df with _i (the row's place), _own, and a window over the rows of a run in order: runs have RUN_ROWS rows of their own and copies of the `ahead` rows that follow."""
    size = max(RUN_ROWS, ahead)
    run = F.floor(F.col("_i") / size)
    first = (F.col("_i") % size < ahead) & (run > 0)
    rows = numbered(df, keys, [time], "_i").withColumn("_run", F.explode(F.when(first, F.array(run, run - 1)).otherwise(F.array(run))))
    return rows.withColumn("_own", F.col("_run") == run), Window.partitionBy(*keys, "_run").orderBy("_i")


def with_previous(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], time: str) -> DataFrame:
    """rows (with _bucket) and _before_{c}: the value in the entity's row before, in whatever bucket that is."""
    values = F.struct(*[F.col(c).alias(c) for c in columns])
    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by(values, F.coalesce(micros(time), F.lit(-(2**62)))).alias("_last"))
    carried = ends.select(*keys, "_bucket", F.lag("_last").over(over_buckets(keys)).alias("_carry"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(micros(time))
    local = rows.withColumns({"_first": F.row_number().over(inner) == 1} | {f"_lag_{c}": F.lag(c).over(inner) for c in columns})
    found = attached(local, carried, keys)
    return found.withColumns({f"_before_{c}": F.when(F.col("_first"), F.col("_carry")[c]).otherwise(F.col(f"_lag_{c}")) for c in columns}).drop("_carry", "_first", *[f"_lag_{c}" for c in columns])


def with_last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, WindowSpec]:
    """df in parts of its first order column (days of a time, ORDER_STEP of a number), _own, and a window over a part in order.

    A part begins with a copy (_own is false) of the row that the entity's part before ends with, of which order and `columns` are kept, so a lag
    of one row needs no more than the part.
    """
    first = F.col(order[0])
    kind = dict(df.dtypes)[order[0]]
    number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    part = F.floor(micros(order[0]) / F.lit(DAY_MICROS)) if kind in TIMES else (F.floor(first / F.lit(ORDER_STEP)) if number else F.lit(0).cast("long"))
    rows = df.withColumns({"_bucket": F.coalesce(part.cast("long"), F.lit(-(2**62))), "_own": F.lit(True)})
    kept = list(dict.fromkeys([*order, *columns]))
    ends = rows.groupBy(*keys, "_bucket").agg(F.max(F.struct(*kept)).alias("_last"))
    halo = ends.select(*keys, F.lead("_bucket").over(over_buckets(keys)).alias("_bucket"), F.lit(False).alias("_own"), *[F.col("_last")[c].alias(c) for c in kept if c not in keys]).where("_bucket is not null")
    return rows.unionByName(halo, allowMissingColumns=True), Window.partitionBy(*keys, "_bucket").orderBy(*kept)


def run_lengths(df: DataFrame, on: Column, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the length of the run of rows for which `on` holds that a row is in; a run may go through any number of buckets."""
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = bucketed(df, keys, order[0]).drop("_own").withColumn("_on", on)
    rows = rows.withColumn("_island", F.sum((~F.col("_on")).cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    bucket = Window.partitionBy(*keys, "_bucket")
    rows = rows.withColumns({"_size": F.count_if("_on").over(Window.partitionBy(*keys, "_bucket", "_island")), "_offs": F.max("_island").over(bucket)})
    # Of each bucket: the run that its first rows are in, the one that its last rows are in, and whether they are one.
    ends = rows.groupBy(*keys, "_bucket").agg(F.count_if(F.col("_on") & (F.col("_island") == 0)).alias("_head"), F.count_if(F.col("_on") & (F.col("_island") == F.col("_offs"))).alias("_tail"), (F.max("_offs") == 0).alias("_whole"))
    ordered = over_buckets(keys)
    broken = (~F.col("_whole")).cast("int")
    upto, onward = ordered.rowsBetween(Window.unboundedPreceding, 0), ordered.rowsBetween(0, Window.unboundedFollowing)
    parts = ends.withColumns({"_from": F.sum(broken).over(upto), "_to": F.sum(broken).over(onward)})
    # A run that reaches the end of a bucket began in the last bucket that is not whole, or at the first.
    sums = parts.withColumns({"_left": F.sum("_tail").over(Window.partitionBy(*keys, "_from").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)), "_right": F.sum("_head").over(Window.partitionBy(*keys, "_to").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, 0))})
    carried = sums.select(*keys, "_bucket", F.coalesce(F.lag("_left").over(ordered), F.lit(0)).alias("_in"), F.coalesce(F.lead("_right").over(ordered), F.lit(0)).alias("_out"))
    found = attached(rows, carried, keys)
    length = F.col("_size") + F.when(F.col("_island") == 0, F.col("_in")).otherwise(0) + F.when(F.col("_island") == F.col("_offs"), F.col("_out")).otherwise(0)
    return found.withColumn(name, F.when(F.col("_on"), length).otherwise(0)).drop("_bucket", "_on", "_island", "_size", "_offs", "_in", "_out")


def running(df: DataFrame, value: Column, how, keys: Sequence[str], order: Sequence[str], name: str, inclusive: bool, none: Column | None = None) -> DataFrame:
    """df with an aggregate (F.max or F.sum) over all rows of the entity before a row, or up to it; `none` where there are no values."""
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = bucketed(df, keys, order[0]).drop("_own").withColumn("_value", value)
    totals = rows.groupBy(*keys, "_bucket").agg(how("_value").alias("_total"))
    carried = totals.select(*keys, "_bucket", before_bucket(F.col("_total"), how, keys).alias("_carry"))
    local = attached(rows.withColumn("_local", how("_value").over(inner)), carried, keys)
    both = F.greatest("_carry", "_local") if how is F.max else F.when(F.col("_carry").isNull() & F.col("_local").isNull(), None).otherwise(F.coalesce("_carry", F.lit(0)) + F.coalesce("_local", F.lit(0)))
    return local.withColumn(name, both if none is None else F.coalesce(both, none)).drop("_bucket", "_value", "_carry", "_local")
