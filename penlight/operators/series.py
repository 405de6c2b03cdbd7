"""Entity time series: aggregation, rolling statistics, windows, splits, scaling, confirmation.

Every function takes and returns DataFrames. Rolling statistics, windows and runs go by
bounded parts of an entity's history (see histories).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penlight.operators import histories
from penlight.operators.histories import DAY_MICROS


def two_level_mean(df: DataFrame, features: Sequence[str], keys: Sequence[str], animal: str | None, spread: Sequence[str] = ()) -> DataFrame:
    """Means within each animal, then over animals; sample std over animals (0 where undefined), animals and frames."""
    df = df.dropna(subset=list(keys))
    if animal is None:
        aggs = [F.avg(c).alias(f"{c}_mean") for c in features] + [F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in spread]
        return df.groupBy(*keys).agg(*aggs, F.count("*").alias("frame_count"))
    each = df.groupBy(*keys, animal).agg(*[F.avg(c).alias(c) for c in features], F.count("*").alias("_frames"))
    aggs = [F.avg(c).alias(f"{c}_mean") for c in features] + [F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in spread]
    return each.groupBy(*keys).agg(*aggs, F.count(animal).alias("pig_count"), F.sum("_frames").alias("frame_count"))


def rolling_features(df: DataFrame, columns: Sequence[str], keys: Sequence[str], time: str = "datetime", days: int = 3) -> DataFrame:
    """Trailing mean, sample std and z-score over (t - days, t], and the change from the row before."""
    span = Window.partitionBy(*keys, "_bucket").orderBy(histories.micros(time)).rangeBetween(1 - days * DAY_MICROS, 0)
    over = {f"_{name}_{c}": f(c).over(span) for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_samp))}
    near = histories.bucketed(df, keys, time, days * DAY_MICROS).withColumns(over).where("_own").drop("_own")
    rows = histories.with_previous(near, columns, keys, time)
    out = {}
    for c in columns:
        mean, std = F.col(f"_mean_{c}"), F.col(f"_std_{c}")
        out |= {
            f"{c}_roll_mean_{days}d": mean,
            f"{c}_roll_std_{days}d": F.coalesce(std, F.lit(0.0)),
            f"{c}_zscore_{days}d": F.coalesce(F.try_divide(F.col(c) - mean, std), F.lit(0.0)),
            f"{c}_delta": F.coalesce(F.col(c) - F.col(f"_before_{c}"), F.lit(0.0)),
        }
    return rows.withColumns(out).select(*df.columns, *out)


def window_table(df: DataFrame, features: Sequence[str], keys: Sequence[str], length: int, time: str = "datetime") -> DataFrame:
    """Mean, max and min of each feature over every full run of `length` rows; one row for each start."""
    rows, ordered = histories.in_runs(df, keys, time, length - 1)
    ahead = ordered.rowsBetween(0, length - 1)
    aggs = {f"{c}__w{name}": f(c).over(ahead) for c in features for name, f in (("mean", F.avg), ("max", F.max), ("min", F.min))}
    out = rows.withColumns(aggs | {"end_datetime": F.lead(time, length - 1).over(ordered), "_rows": F.count("*").over(ahead)})
    return out.where(F.col("_own") & (F.col("_rows") == length)).select(*keys, F.col(time).alias("start_datetime"), "end_datetime", F.col("_i").alias("window_start_index"), *aggs)


def sequences(df: DataFrame, features: Sequence[str], keys: Sequence[str], length: int, time: str = "datetime", last: Sequence[str] = ()) -> DataFrame:
    """Every full run of `length` rows as a matrix column beside its start, end and the `last` columns of its final row."""
    rows, ordered = histories.in_runs(df, keys, time, length - 1)
    ahead = ordered.rowsBetween(0, length - 1)
    row = F.array(*[F.col(c).cast("double") for c in features])
    out = rows.withColumns({"matrix": F.collect_list(row).over(ahead), "end_datetime": F.lead(time, length - 1).over(ordered)} | {f"end_{c}": F.lead(c, length - 1).over(ordered) for c in last})
    return out.where(F.col("_own") & (F.size("matrix") == length)).select(*keys, F.col(time).alias("start_datetime"), "end_datetime", *[f"end_{c}" for c in last], "matrix")


def labelled_windows(df: DataFrame, label: str, split: str, keys: Sequence[str], length: int, time: str = "datetime") -> DataFrame:
    """For each full run of `length` rows: commonest split (smallest on a tie), mean and max of the label, rows."""
    rows, ordered = histories.in_runs(df, keys, time, length - 1)
    ahead = ordered.rowsBetween(0, length - 1)
    out = rows.withColumns({"window_split": F.mode(split, True).over(ahead), "label_mean": F.avg(label).over(ahead), "label_max": F.max(label).over(ahead), "rows": F.count("*").over(ahead), "end_datetime": F.lead(time, length - 1).over(ordered)})
    return out.where(F.col("_own") & (F.col("rows") == length)).select(*keys, F.col(time).alias("start_datetime"), "end_datetime", "window_split", "label_mean", "label_max", "rows")


def dense_bins(df: DataFrame, features: Sequence[str], keys: Sequence[str], seconds: int, time: str = "datetime") -> DataFrame:
    """Means over time bins; bins without rows stay, as nulls, between each entity's first and last."""
    bin_of = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds) * seconds
    means = df.withColumn("_bin", bin_of).groupBy(*keys, "_bin").agg(*[F.avg(c).alias(c) for c in features])
    ends = means.groupBy(*keys).agg(F.min("_bin").alias("_a"), F.max("_bin").alias("_b"))
    spine = ends.select(*keys, F.explode(F.sequence("_a", "_b", F.lit(seconds).cast("long"))).alias("_bin"))
    joined = spine.join(means.hint("merge"), [*keys, "_bin"], "left")
    return joined.select(*keys, F.timestamp_seconds("_bin").cast("timestamp_ntz").alias(time), *features)


def interpolated(df: DataFrame, columns: Sequence[str], keys: Sequence[str], time: str = "datetime") -> DataFrame:
    """Nulls filled on the line between the nearest rows that have values, by row position; at the ends by the nearest one."""
    ordered = Window.partitionBy(*keys).orderBy(time)
    back = ordered.rowsBetween(Window.unboundedPreceding, 0)
    ahead = ordered.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_i", F.row_number().over(ordered))
    for c in columns:
        point = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        df = df.withColumns({"_p": F.last(point, True).over(back), "_n": F.first(point, True).over(ahead)})
        slope = F.try_divide(F.col("_n.v") - F.col("_p.v"), F.col("_n.i") - F.col("_p.i"))
        line = F.col("_p.v") + slope * (F.col("_i") - F.col("_p.i"))
        df = df.withColumn(c, F.coalesce(c, line, "_p.v", "_n.v"))
    return df.drop("_i", "_p", "_n")


def confirm_runs(df: DataFrame, flag: str, keys: Sequence[str], order: Sequence[str], required: int = 3, name: str = "confirmed") -> DataFrame:
    """Keeps a flag only in runs of at least `required` rows; runs end with their entity."""
    on = F.coalesce(F.col(flag), F.lit(False))
    return histories.run_lengths(df, on, keys, order, "_length").withColumn(name, F.col("_length") >= required).drop("_length")


def split_by_time(df: DataFrame, keys: Sequence[str], train_ratio: float, length: int, least_windows: int = 10, time: str = "datetime") -> tuple[DataFrame, DataFrame]:
    """Chronological split of each entity that leaves at least `least_windows` validation windows.

    Returns (rows tagged `split`; a row of a short entity may be in both parts) and a
    summary with status for each entity.
    """
    ordered = Window.partitionBy(*keys).orderBy(time)
    n = F.count("*").over(Window.partitionBy(*keys))
    least = length + least_windows - 1
    total = F.col("total_rows")
    val = F.least(total, F.greatest(F.ceil(total * F.lit(1 - train_ratio)), F.lit(least)))
    apart = total >= length + F.col("val_rows")
    train = F.when(apart, total - F.col("val_rows")).otherwise(F.least(total, F.greatest(F.lit(length), F.floor(total * F.lit(train_ratio)))))
    rows = df.withColumns({"total_rows": n, "_i": F.row_number().over(ordered)}).withColumn("val_rows", val).withColumn("train_rows", train)
    windows = lambda c: F.greatest(F.lit(0), F.col(c) - (length - 1))
    usable = (total >= length) & (windows("train_rows") > 0) & (windows("val_rows") > 0)
    tags = F.array_compact(F.array(F.when(F.col("_i") <= F.col("train_rows"), "train"), F.when(F.col("_i") > total - F.col("val_rows"), "val")))
    tagged = rows.where(usable).withColumn("split", F.explode(tags)).select(*df.columns, "split")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("total_rows")).withColumn("val_rows", val).withColumn("train_rows", train)
    short = total < length
    status = F.when(short, "skipped_too_short").when((windows("train_rows") == 0) | (windows("val_rows") == 0), "skipped_no_windows").when(apart, "non_overlapping").otherwise("overlap_for_short_group")
    zero = lambda c: F.when(short, 0).otherwise(c).cast("long")
    summary = sizes.select(
        *keys,
        "total_rows",
        zero(F.col("train_rows")).alias("train_rows"),
        zero(F.col("val_rows")).alias("val_rows"),
        zero(windows("train_rows")).alias("train_windows"),
        zero(windows("val_rows")).alias("val_windows"),
        zero(F.when(apart, 0).otherwise(F.greatest(F.lit(0), F.col("train_rows") + F.col("val_rows") - total))).alias("overlap_rows"),
        status.alias("status"),
    )
    return tagged, summary


def split_by_ratio(df: DataFrame, keys: Sequence[str], train_ratio: float, time: str = "datetime") -> DataFrame:
    """The first floor(n * ratio) rows of each entity are `train`, the others `val`."""
    ordered = Window.partitionBy(*keys).orderBy(time)
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("split", F.when(F.row_number().over(ordered) <= F.floor(n * F.lit(train_ratio)), "train").otherwise("val"))


def fit_scaler(train: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population std (1 where 0) of each feature for each entity, or over all rows without keys."""
    aggs = [x for c in features for x in (F.avg(c).alias(f"{c}_center"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}_scale"))]
    return train.groupBy(*keys).agg(*aggs)


def scale(df: DataFrame, scaler: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """df with scaled features; an entity that the scaler has not seen is an error when its row is read."""
    if keys:
        # df may come from an explode, whose size Spark does not know.
        joined = df.join(scaler.withColumn("_seen", F.lit(True)).hint("merge"), list(keys), "left")
        known = F.coalesce(F.col("_seen"), F.raise_error(F.concat(F.lit("no scaler for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))).cast("boolean"))
    else:
        # One row of statistics.
        joined, known = df.join(F.broadcast(scaler)), F.lit(True)
    scaled = {c: F.when(known, (F.col(c) - F.col(f"{c}_center")) / F.col(f"{c}_scale")) for c in features}
    return joined.withColumns(scaled).select(*df.columns)


def resampled(df: DataFrame, keys: Sequence[str], seconds: int, time: str = "datetime") -> DataFrame:
    """Time bins with sums of counts and movement, maxima of max_*, means of the other numbers, and frames."""
    bin_of = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    aggs = []
    for field in df.schema:
        c = field.name
        if c in keys or c == time or field.dataType.typeName() not in ("double", "float", "long", "integer"):
            continue
        how = F.sum if c.endswith("_count") or "movement" in c else F.max if c.startswith("max_") else F.avg
        aggs.append(how(c).alias(c))
    return df.withColumn(time, bin_of).groupBy(*keys, time).agg(*aggs, F.count("*").alias("frames"))


def drop_features(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """Change from the day before and z-score over the entity's whole history."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    z = F.try_divide(F.col(value) - F.avg(value).over(whole), F.stddev_samp(value).over(whole))
    return df.withColumns({f"{value}_change": F.try_divide(F.col(value), F.lag(value).over(ordered)) - 1, f"{value}_zscore": z})


def rolling_rows(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """Mean of three rows, and the drops in percent from one and three rows before (positive on a drop)."""
    ordered = Window.partitionBy(*keys).orderBy(order)
    drop = lambda k: -100 * (F.try_divide(F.col(value), F.lag(value, k).over(ordered)) - 1)
    return df.withColumns({f"{value}_3d_mean": F.avg(value).over(ordered.rowsBetween(-2, 0)), f"{value}_drop_pct_1d": drop(1), f"{value}_drop_pct_3d": drop(3)})
