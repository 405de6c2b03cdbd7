"""Operators built from others: model inputs, what-if cases, rollups of scored tables, evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penlight.operators import events, quality, rules, series

#: Feature profiles; the last one leaves label columns out, so that no model sees its label.
PROFILES = {"behaviour": ("lying", "standing", "change_rate"), "behaviour_muscle": ("lying", "standing", "change_rate", "muscle"), "full": ("lying", "standing", "change_rate", "muscle", "temperature", "feed")}
LABEL_PARTS = ("estrus", "injection", "label", "condition")


def profile_features(columns: Sequence[str], profile: str | None = None) -> list[str]:
    """Columns of a named profile, or all that are no labels."""
    if profile is not None:
        return [c for c in PROFILES[profile] if c in columns]
    return [c for c in columns if not any(p in c.lower() for p in LABEL_PARTS)]


def model_ready(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """Known columns of breathing rows, or of points where there is no kind."""
    keep = F.col("kind") == "breathing" if "kind" in df.columns else F.col("annotation_type") == "points" if "annotation_type" in df.columns else F.lit(True)
    return df.where(keep).select(*[c for c in known if c in df.columns])


def image_features(rows: DataFrame, keys: Sequence[str], order: str, actions: Sequence[str]) -> DataFrame:
    """Per image: annotations, shares of actions and flags, mean centre, and how far it moved since the image before."""
    share = lambda c: F.avg(c.cast("double"))
    per = rows.groupBy(*keys, order).agg(F.count("*").alias("annotations"), *[share(F.col("action") == a).alias(f"{a}_ratio") for a in actions], share(F.col("estrus") == 1).alias("estrus_ratio"), F.avg("center_x").alias("center_x"), F.avg("center_y").alias("center_y"))
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.sqrt(F.pow(F.col("center_x") - F.lag("center_x").over(w), F.lit(2)) + F.pow(F.col("center_y") - F.lag("center_y").over(w), F.lit(2)))
    return per.withColumn("movement", F.coalesce(step, F.lit(0.0)))


def resampled_animals(rows: DataFrame, keys: Sequence[str], time: str, means: Sequence[str], spreads: Sequence[str], condition: str, seconds: int = 600) -> DataFrame:
    """Bins of one animal: means, sample spreads, source rows, commonest condition (smallest on a tie)."""
    bin_of = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    return rows.withColumn(time, bin_of).groupBy(*keys, time).agg(*[F.avg(c).alias(c) for c in means], *[F.stddev_samp(c).alias(f"{c}_std") for c in spreads], F.count("*").alias("source_rows"), F.mode(condition, True).alias(condition))


def elapsed_day(rows: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Whole days since the entity's first row, from 1."""
    first = F.min(time).over(Window.partitionBy(*keys))
    return rows.withColumn("elapsed_day", F.floor((F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))) / 86400) + 1)


def category_risk(scored: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Alerts, mean and largest score of each category."""
    one = scored.agg(*[F.struct(F.count_if(F.col(f"{c}_rule_anomaly")).alias("alerts"), F.avg(f"{c}_rule_score").alias("mean_score"), F.max(f"{c}_rule_score").alias("max_score")).alias(c) for c in categories])
    return one.unpivot([], list(categories), "category", "s").select("category", "s.*")


def best_hit(flags: DataFrame, needed: Sequence[str], reasons: str, score: str, keys: Sequence[str]) -> DataFrame:
    """The row of highest score whose reasons hold all needed rules."""
    held = F.size(F.array_except(F.array(*[F.lit(r) for r in needed]), F.split(reasons, ","))) == 0
    return flags.where(held).orderBy(F.desc(score), *keys).limit(1)


def policy_examples(df: DataFrame, value: str, policies: Mapping[str, float], order: Sequence[str], most: int = 20) -> DataFrame:
    """Up to `most` alerts of each policy, highest values first; the number is the report's."""
    p = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(float(t)).alias("threshold")) for n, t in policies.items()])
    rows = df.withColumn("_p", F.explode(p)).select("*", "_p.*").drop("_p").where(F.col(value) >= F.col("threshold"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("policy").orderBy(F.desc(value), *order))).where(F.col("rank") <= most)


def injected(windows: DataFrame, cases: Mapping[str, Mapping[str, float]], rule_set: Sequence[Mapping], keys: Sequence[str]) -> DataFrame:
    """Every window under every case of overridden features: the rules that fire. Cases are arrays of overrides, so no join is needed."""
    names = sorted({c for o in cases.values() for c in o})
    options = F.array(*[F.struct(F.lit(n).alias("case"), *[F.lit(o.get(c)).cast("double").alias(c) for c in names]) for n, o in cases.items()])
    rows = windows.withColumn("_o", F.explode(options)).withColumns({c: F.coalesce(F.col(f"_o.{c}"), F.col(c)) for c in names}).withColumn("case", F.col("_o.case"))
    return rules.evaluate(rows, rule_set, [*keys, "case"]).select(*keys, "case", "rule_reasons", "rule_score")


def gated(scored: DataFrame, precision: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """precision_alert of a policy's mask; rows without one pass. suppressed: an alert that the mask rejects."""
    if precision is None:
        return scored.withColumns({"precision_alert": F.lit(True), "suppressed": F.lit(False)})
    out = scored.join(precision.select(*keys, F.col("precision_alert").alias("_a")), list(keys), "left").withColumn("precision_alert", F.coalesce("_a", F.lit(True))).drop("_a")
    return out.withColumn("suppressed", ~F.col("precision_alert") & (F.col("rule_score") > 0))


def expected_recall(sets: Mapping[str, DataFrame]) -> DataFrame:
    """Labelled event sets: events, hits and recall by set and expected rule. Sets have expected_rule and hit."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(n).alias("set"), "expected_rule", "hit") for n, df in sets.items()])
    return rows.groupBy("set", "expected_rule").agg(F.count("*").alias("events"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("recall"))


def evidence(parts: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One line for each source from a row of numbers: title and text. An empty source is an error."""
    lines = []
    for title, (df, form) in parts.items():
        names = [f.strip("{}") for f in form.split() if f.startswith("{")]
        text = F.concat_ws(" ", *[F.coalesce(F.round(F.col(w.strip("{}")), 3).cast("string"), F.lit("-")) if w.startswith("{") else F.lit(w) for w in form.split()])
        if df.select(*names).isEmpty():
            raise ValueError(f"no rows for {title}")
        lines.append(df.limit(1).select(F.lit(title).alias("title"), text.alias("text")))
    return reduce(lambda a, b: a.unionByName(b), lines)


def tagged_union(parts: Mapping[str, DataFrame], name: str = "split") -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(name, F.lit(n)) for n, df in parts.items()])


def shared_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns that both sides have and hold values in."""
    def present(df: DataFrame) -> DataFrame:
        counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
        return counts.unpivot([], df.columns, "feature", "n").where("n > 0").select("feature")

    return present(left).join(present(right).hint("merge"), "feature")


def track_inputs(hourly: DataFrame, features: Sequence[str], keys: Sequence[str], length: int, ratio: float = 0.8, least_windows: int = 10) -> tuple[DataFrame, DataFrame]:
    """Model inputs of a track: imputed, split by time, scaled on training rows, as window matrices with their split; and the split's summary."""
    filled = quality.imputed(hourly, features)
    rows, summary = series.split_by_time(filled, keys, ratio, length, least_windows)
    fit = series.fit_scaler(rows.where("split = 'train'"), features, keys)
    scaled = series.scale(rows, fit, features, keys)
    return series.sequences(scaled, features, [*keys, "split"], length), summary


def clean_inputs(hourly: DataFrame, confirmed: DataFrame, key: str, features: Sequence[str], keys: Sequence[str], length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model inputs without the rows inside confirmed windows, the split's summary, and rows before and after."""
    clean = events.outside_windows(hourly, confirmed, key, "datetime")
    inputs, summary = track_inputs(clean, features, keys, length)
    before, after = hourly.agg(F.count("*").alias("rows_before")), clean.agg(F.count("*").alias("rows_after"))
    # One row each.
    return inputs, summary, before.join(F.broadcast(after))


def grouped_errors(scored: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    return scored.groupBy(*keys).agg(F.count("*").alias("windows"), F.min(error).alias("min_error"), F.percentile(error, F.lit(0.5)).alias("median_error"), F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))


def event_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("events"), F.avg("severity").alias("mean_severity"), F.max("severity").alias("max_severity"))


def loose_label(v: Column) -> dict[str, Column]:
    """Box, centre and free area of a loose label document (variant): two keypoints, where there are, give the centre."""
    get = lambda p, kind="double": F.try_variant_get(v, p, kind)
    width, height = get("$.width"), get("$.height")
    x, y, w, h = (get(f"$.bbox[{i}]") for i in range(4))
    points = get("$.keypoints", "array<double>")
    two = F.coalesce(F.size(points) == 4, F.lit(False))
    return {"center_x": F.when(two, (points[0] + points[2]) / 2).otherwise(x + w / 2), "center_y": F.when(two, (points[1] + points[3]) / 2).otherwise(y + h / 2), "area_ratio": F.try_divide(w * h, width * height), "free_ratio": 1 - F.try_divide(w * h, width * height), "frame": get("$.frame", "string").try_cast("long")}
