"""Exact percentiles and order statistics without a buffer that holds all values.

Two passes. The first takes a mergeable sketch and from it, for every wanted rank, two
values that are certain to lie on either side; what it sends on is one small row for each
group. The second counts what lies below the lower value and, value by value, what lies
between both: a share of `14 / ACCURACY` of the rows. Running sums over these give the
value at the rank. Rows never move, and the values of one group meet in one task only
between its two bounds, where they are sorted, not held.

Null and NaN are no values. Percentiles between two ranks are interpolated, as
`percentile` does, and equal its results to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penlight.functions.tables import written

#: Of the sketch: a rank may be off by the number of values over this.
ACCURACY = 20_000
#: How far on either side of a rank its bounds are looked up, as a share of the values.
MARGIN = 6 / ACCURACY


def values_of(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature and value, a row for each value of each column."""
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*").where(F.col("value").isNotNull() & ~F.isnan("value"))


def same(left: Sequence[str], right: Sequence[str]) -> list[Column]:
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]


def percentiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature, n and quantiles: of every column with values the percentiles at `fractions`, in their order."""
    values, group = values_of(df, columns, keys), [*keys, "feature"]
    ends = [min(max(p + side * MARGIN, 0.0), 1.0) for p in fractions for side in (-1, 1)]
    sketch = values.groupBy(*group).agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"), F.percentile_approx("value", ends, ACCURACY).alias("cuts"))
    # So few values lie between all bounds together that the sketch would not save any.
    few = F.col("n") <= ACCURACY // 4
    low = [F.when(few, F.col("a")).otherwise(F.col("cuts")[2 * i]) for i in range(len(fractions))]
    high = [F.when(few, F.col("b")).otherwise(F.col("cuts")[2 * i + 1]) for i in range(len(fractions))]
    bounds = written(sketch.select(*[F.col(c).alias(f"_{c}") for c in group], "n", F.array(*low).alias("low"), F.array(*high).alias("high")), "bounds")
    # One row for each column if there are no keys; else Spark sees how large the written table is.
    joined = values.join(bounds if keys else F.broadcast(bounds), same(group, [f"_{c}" for c in group]))
    value = F.col("value")
    places = F.transform(F.sequence(F.lit(0), F.lit(len(fractions) - 1)), lambda i: F.when(value <= F.col("high")[i], F.struct(i.alias("i"), F.when(value >= F.col("low")[i], value).alias("v"))))
    held = joined.select(*group, "n", F.explode(F.array_compact(places)).alias("x")).select(*group, "n", "x.*").groupBy(*group, "n", "i", "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(*group, "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    position = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in fractions]), F.col("i") + 1)
    rows = held.withColumn("upto", upto).withColumn("position", position)
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    beyond = F.coalesce(F.bool_or(F.col("v").isNull() & (F.col("upto") > F.floor("position"))), F.lit(False))
    found = rows.groupBy(*group, "n", "i", "position").agg(at(F.floor("position")).alias("lower"), at(F.ceil("position")).alias("upper"), beyond.alias("beyond"))
    wrong = F.col("beyond") | F.col("lower").isNull() | F.col("upper").isNull()
    between = (F.ceil("position") - F.col("position")) * F.col("lower") + (F.col("position") - F.floor("position")) * F.col("upper")
    quantile = F.when(wrong, F.raise_error(F.lit("the bounds of a percentile do not hold it")).cast("double")).when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(between)
    listed = found.groupBy(*group, "n").agg(F.array_sort(F.collect_list(F.struct("i", quantile.alias("q")))).alias("q"))
    return listed.select(*group, "n", F.transform("q", lambda x: x["q"]).alias("quantiles"))


def one_row(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """One row: for each column the array of its percentiles, null without values."""
    found = percentiles(df, columns, fractions)
    return found.agg(*[F.max(F.when(F.col("feature") == c, F.col("quantiles"))).alias(c) for c in columns])


def with_percentiles(stats: DataFrame, df: DataFrame, columns: Sequence[str], fractions: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """stats, which has a row for each of keys and feature, with `quantiles`."""
    group = [*keys, "feature"]
    found = percentiles(df, columns, fractions, keys).select(*[F.col(c).alias(f"_{c}") for c in group], "quantiles")
    return stats.join(found.hint("merge"), same(group, [f"_{c}" for c in group]), "left").drop(*[f"_{c}" for c in group])


def at_ranks(df: DataFrame, column: str, ranks: DataFrame, first: int, last: int, n: int) -> DataFrame:
    """ranks (column rank, from 0, all within first and last) with `value`: the value of that rank among the n values of the column."""
    values = values_of(df, [column]).select("value")
    ends = [max(first / n - MARGIN, 0.0), min((last + 1) / n + MARGIN, 1.0)]
    sketch = values.agg(F.percentile_approx("value", ends, ACCURACY).alias("cuts"), F.min("value").alias("a"), F.max("value").alias("b"))
    few = n <= ACCURACY // 4
    bounds = sketch.select((F.col("a") if few else F.col("cuts")[0]).alias("low"), (F.col("b") if few else F.col("cuts")[1]).alias("high"))
    # One row.
    near = values.join(F.broadcast(bounds)).where(F.col("value") <= F.col("high"))
    held = near.groupBy(F.when(F.col("value") >= F.col("low"), F.col("value")).alias("value")).agg(F.count("*").alias("k"))
    # The values between both bounds and the ranks meet in one order, so that each rank sees the next value.
    upto = F.sum("k").over(Window.orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)) - 1
    known = held.select(upto.alias("rank"), "value", F.lit(1).alias("kind"))
    asked = ranks.select("rank").distinct().select("rank", F.lit(None).cast("double").alias("value"), F.lit(0).alias("kind"))
    following = Window.orderBy("rank", "kind").rowsBetween(0, Window.unboundedFollowing)
    both = known.unionByName(asked).withColumn("value", F.first("value", ignorenulls=True).over(following)).where("kind = 0").drop("kind")
    return ranks.join(both.hint("merge"), "rank")
