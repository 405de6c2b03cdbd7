"""Data quality: coercion, masking, imputation, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penlight.operators.quantiles import one_row

# Plausible ranges of readings.
PLAUSIBLE = {
    "rectal_temperature_mean": (35.0, 42.0),
    "back_temperature_mean": (25.0, 42.0),
    "neck_temperature_mean": (25.0, 42.0),
    "head_temperature_mean": (25.0, 42.0),
    "barn_temperature_mean": (-10.0, 45.0),
}


def coerced(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles, NaN as null; absent ones are added as nulls."""
    value = lambda c: F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")
    return df.withColumns({c: F.when(~F.isnan(value(c)), value(c)) for c in features})


def time_index(df: DataFrame, stamp: str = "timestamp", date: str = "date", clock: str = "time", name: str = "datetime") -> DataFrame:
    """The time of a row from its stamp, else from date and time as yyMMddHHmm; rows without one go."""
    found = F.coalesce(F.try_to_timestamp(stamp).cast("timestamp_ntz"), F.try_to_timestamp(F.concat(F.trim(date), F.trim(clock)), F.lit("yyMMddHHmm")).cast("timestamp_ntz"))
    return df.withColumn(name, found).dropna(subset=[name])


def implausible_masked(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = PLAUSIBLE) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).between(*r), F.col(c)) for c, r in ranges.items() if c in df.columns})


def implausible_counts(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = PLAUSIBLE) -> DataFrame:
    """feature, filtered_rows and total_present_rows, in one pass."""
    known = [c for c in ranges if c in df.columns]
    counts = df.agg(*[F.struct(F.count_if(~F.col(c).between(*ranges[c])).alias("filtered_rows"), F.count(c).alias("total_present_rows")).alias(c) for c in known])
    return counts.unpivot([], known, "feature", "s").select("feature", "s.filtered_rows", "s.total_present_rows")


def sentinel_masked(df: DataFrame, columns: Sequence[str], codes: Sequence[float], positive: Sequence[str] = ()) -> DataFrame:
    """Sensor codes for "no value" as nulls; `positive` columns also lose values of 0 and less."""
    kept = lambda c: ~F.col(c).isin(*codes) & ((F.col(c) > 0) if c in positive else F.lit(True))
    return df.withColumns({c: F.when(kept(c), F.col(c)) for c in columns})


def sentinel_counts(df: DataFrame, columns: Sequence[str], codes: Sequence[float]) -> DataFrame:
    counts = df.agg(*[F.struct(F.count_if(F.col(c).isin(*codes)).alias("n"), F.count("*").alias("rows")).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "s").select("column", F.col("s.n").alias("sentinels"), F.try_divide(100.0 * F.col("s.n"), F.col("s.rows")).alias("sentinel_pct"))


def imputed(df: DataFrame, features: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Nulls as the feature's median over `fit` (all rows of df if None), as 0 where there is none."""
    medians = one_row(fit if fit is not None else df, features, [0.5]).select(*[F.col(c)[0].alias(f"_{c}") for c in features])
    # One row of medians.
    return df.join(F.broadcast(medians)).withColumns({c: F.coalesce(c, f"_{c}", F.lit(0.0)) for c in features}).select(*df.columns)


def imputation_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.struct((F.count("*") - F.count(c)).alias("missing"), F.count(c).alias("present")).alias(c) for c in features])
    long = counts.unpivot([], list(features), "feature", "s").select("feature", F.col("s.missing").alias("missing"), F.col("s.present").alias("present"))
    return long.select("feature", "missing", F.when(F.col("present") > 0, F.col("missing")).otherwise(0).alias("median_filled"), F.when(F.col("present") == 0, F.col("missing")).otherwise(0).alias("zero_filled"))


def usable_features(df: DataFrame, keys: Sequence[str], include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Names of columns beside the keys that hold any value; an error if none are left."""
    names = [c for c in df.columns if c not in keys and (include is None or c in include) and c not in exclude]
    counts = df.agg(*[F.count(c).alias(c) for c in names]).head() if names else ()
    found = [c for c, n in zip(names, counts) if n]
    if not found:
        raise ValueError("no usable feature columns")
    return found


def validation_issues(df: DataFrame, required: Sequence[str], features: Sequence[str], time: str, missing_pct: float = 80.0, parsed_pct: float = 100.0) -> DataFrame:
    """column, check and value: required columns that are absent, time stamps that do not parse, features mostly missing."""
    absent = [c for c in required if c not in df.columns]
    share = lambda cond: F.coalesce(100.0 * F.avg(cond.cast("double")), F.lit(0.0))
    known = [c for c in features if c in df.columns]
    checks = [F.struct(F.lit(c).alias("column"), F.lit("missing_pct").alias("check"), share(F.col(c).isNull()).alias("value"), F.lit(missing_pct).alias("limit")) for c in known]
    if time in df.columns:
        checks.append(F.struct(F.lit(time).alias("column"), F.lit("unparsed_pct").alias("check"), share(F.col(time).isNull()).alias("value"), F.lit(100.0 - parsed_pct).alias("limit")))
    found = df.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("c")).select("c.*").where(F.col("value") > F.col("limit")).select("column", "check", "value")
    lacking = df.sparkSession.createDataFrame([(c, "required_column", 1.0) for c in absent], found.schema) if absent else None
    return found if lacking is None else lacking.unionByName(found)


def missing_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.coalesce(100.0 * F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "missing_pct")


def normal_key(key: Column) -> Column:
    """Without a decimal .0; of the rest the first run of three digits or more, if any."""
    plain = F.regexp_replace(key.cast("string"), r"\.0$", "")
    return F.coalesce(F.nullif(F.regexp_extract(plain, r"(\d{3,})", 1), F.lit("")), plain)


def mixed_date(text: Column) -> Column:
    """yyyyMMdd, ISO or day/month/year text as a date; null if it is none of them."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))
        .when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(t, F.lit("d/M/yyyy")))
        .cast("date")
    )


def pen_label(value: Column, experiment: Column) -> Column:
    """A2 of experiment 3 as A2.3."""
    v = F.trim(value)
    return F.when(v.rlike(r"^[A-Z]\d$"), F.concat_ws(".", v, experiment.cast("string"))).otherwise(v)


def station_number(label: Column) -> Column:
    return F.regexp_extract(F.trim(label), r"^F(\d+)$", 1).try_cast("long")


def flag(text: Column, extra_true: Sequence[str] = (), unknown: bool | None = None) -> Column:
    """Words for true and false; anything else is `unknown`."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "t", "yes", "y", "1", *extra_true), True).when(t.isin("false", "f", "no", "n", "0"), False).otherwise(F.lit(unknown))


def leading_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(-?\d+\.?\d*)", 1).try_cast("double")


def has_token(csv: Column, token: str) -> Column:
    """Membership in a comma list."""
    return F.coalesce(F.array_contains(F.transform(F.split(csv, ","), F.trim), token), F.lit(False))


def clip_parts(name: Column) -> dict[str, Column]:
    """Date, channel, facility and pen of a clip name such as 20230105_ch02_facility3_pen07."""
    number = lambda p: F.regexp_extract(name, p, 1).try_cast("long")
    facility = number(r"(?i)facility(\d+)")
    return {"clip_date": F.try_to_timestamp(F.regexp_extract(name, r"(\d{8})", 1), F.lit("yyyyMMdd")).cast("date"), "channel": number(r"(?i)ch(\d+)"), "facility": facility, "pen": number(r"(?i)pen(\d+)"), "chamber": F.coalesce(number(r"(?i)chamber(\d+)"), facility)}
