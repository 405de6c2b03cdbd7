"""Keypoints, boxes, tracks and cohorts: frame features, motion, rollups, timelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penlight.operators import histories

# Labels of annotated behaviour, and which of them count as active or resting.
LABELS = ("walking", "running", "feeding", "drinking", "standing", "sitting", "lying", "sleeping", "fighting", "mounting", "playing", "rooting", "defecating", "unlabeled")
ACTIVE, REST = ("walking", "running", "feeding", "drinking", "fighting", "mounting", "playing", "rooting"), ("sitting", "lying", "sleeping")
SLOW, FAST = 5.0, 40.0


def frame_activity(points: DataFrame, keys: Sequence[str], labels: Sequence[str] = LABELS) -> DataFrame:
    """Per frame: annotations, means and population spread of centres, largest span, counts and shares of labels."""
    p = points.withColumns({"label": F.coalesce("label", F.lit("unlabeled"))} | {c: F.coalesce(c, F.lit(0.0)) for c in ("center_x", "center_y", "span_x", "span_y")})
    counts = {f"{x}_count": F.count_if(F.col("label") == x) for x in labels}
    out = p.groupBy(*keys).agg(
        F.count("*").alias("annotations"), F.sum("point_count").alias("points"),
        F.avg("center_x").alias("center_x_mean"), F.avg("center_y").alias("center_y_mean"), F.stddev_pop("center_x").alias("center_x_std"), F.stddev_pop("center_y").alias("center_y_std"),
        F.avg("span_x").alias("span_x_mean"), F.max("span_x").alias("max_span_x"), F.max("span_y").alias("max_span_y"), *[c.alias(n) for n, c in counts.items()],
    )
    total = lambda some: reduce(lambda a, b: a + b, [F.col(f"{x}_count") for x in some if x in labels], F.lit(0))
    share = {f"{x}_ratio": F.try_divide(F.col(f"{x}_count"), F.col("annotations")) for x in labels}
    sums = {"active_count": total(ACTIVE), "rest_count": total(REST)}
    return out.withColumns(share | sums | {"active_ratio": F.try_divide(sums["active_count"], F.col("annotations")), "rest_ratio": F.try_divide(sums["rest_count"], F.col("annotations"))})


def behaviour_series(frames: DataFrame, keys: Sequence[str], labels: Sequence[str], seconds: int = 600, time: str = "datetime") -> DataFrame:
    """Time bins with counts summed and shares taken of the sums (not averaged)."""
    bin_of = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    out = frames.withColumn(time, bin_of).groupBy(*keys, time).agg(F.sum("annotations").alias("annotations"), F.count("*").alias("frames"), *[F.sum(f"{x}_count").alias(f"{x}_count") for x in labels])
    return out.withColumns({f"{x}_ratio": F.try_divide(F.col(f"{x}_count"), F.col("annotations")) for x in labels})


def posture_shares(rows: DataFrame, keys: Sequence[str], posture: str, postures: Sequence[str], order: Sequence[str], means: Sequence[str], condition: str, bin_col: str) -> DataFrame:
    """Shares of postures, share of rows whose posture changed, means, and commonest condition (smallest on a tie) by bin."""
    parts, ordered = histories.with_last_before(rows, keys, order, [posture])
    changed = (F.col(posture) != F.lag(posture).over(ordered)).cast("double")
    tagged = parts.withColumn("_c", F.coalesce(changed, F.lit(0.0))).where("_own")
    # Sums by condition first: few rows are left for each bin, and the commonest condition needs no map of its own.
    shares = {f"{p}_share": (F.col(posture) == p).cast("double") for p in postures} | {"change_rate": F.col("_c")} | {m: F.col(m) for m in means}
    sums = tagged.groupBy(*keys, bin_col, F.col(condition).alias("_k")).agg(F.count("*").alias("_n"), *[f(c).alias(f"_{s}_{k}") for k, c in shares.items() for s, f in (("sum", F.sum), ("of", F.count))])
    # Smallest on a tie: the first in order of falling counts.
    best = F.min(F.when(F.col("_k").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_k").alias("k"))))["k"]
    return sums.groupBy(*keys, bin_col).agg(*[F.try_divide(F.sum(f"_sum_{k}"), F.sum(f"_of_{k}")).alias(k) for k in shares], best.alias(condition), F.sum("_n").alias("rows"))


def box_geometry(boxes: DataFrame) -> DataFrame:
    """Centre, area and frame diagonal; where the frame's size is unknown, the diagonal of the farthest centre."""
    rows = boxes.withColumns({"center_x": F.col("x") + F.col("w") / 2, "center_y": F.col("y") + F.col("h") / 2, "area": F.col("w") * F.col("h")})
    known = F.sqrt(F.pow("frame_width", F.lit(2)) + F.pow("frame_height", F.lit(2)))
    far = rows.agg(F.sqrt(F.pow(F.max("center_x"), F.lit(2)) + F.pow(F.max("center_y"), F.lit(2))).alias("_far"))
    # One row.
    return rows.join(F.broadcast(far)).withColumn("diagonal", F.coalesce(known, F.col("_far"))).drop("_far")


def track_motion(boxes: DataFrame, keys: Sequence[str] = ("source_video", "track_id"), fps: float = 30.0) -> DataFrame:
    """Distance from the track's box before, in total, for each frame, over the diagonal and each second, with flags; null without a positive gap."""
    parts, ordered = histories.with_last_before(boxes, keys, ["frame"], ["center_x", "center_y"])
    gap = F.col("frame") - F.lag("frame").over(ordered)
    step = F.sqrt(F.pow(F.col("center_x") - F.lag("center_x").over(ordered), F.lit(2)) + F.pow(F.col("center_y") - F.lag("center_y").over(ordered), F.lit(2)))
    out = parts.withColumns({"frame_gap": gap, "movement": F.when(gap > 0, step)}).where("_own").select(*boxes.columns, "frame_gap", "movement")
    speed = F.try_divide(F.col("movement"), F.col("frame_gap"))
    return out.withColumns({"movement_per_frame": speed, "movement_norm": F.try_divide(F.col("movement"), F.col("diagonal")), "speed": speed * fps, "low_motion": speed < SLOW, "high_motion": speed > FAST})


def track_summary(motion: DataFrame, keys: Sequence[str] = ("source_video", "pen_id", "track_id")) -> DataFrame:
    span = F.max("frame") - F.min("frame") + 1
    share = lambda c: F.avg(F.col(c).cast("double"))
    return motion.groupBy(*keys).agg(
        span.alias("span_frames"), F.count_distinct("frame").alias("observed_frames"), F.try_divide(F.count_distinct("frame"), span).alias("coverage"), F.avg("conf").alias("mean_conf"),
        F.sum("movement").alias("movement_total"), F.avg("movement").alias("movement_mean"), F.percentile("movement", F.lit(0.95)).alias("movement_p95"), share("low_motion").alias("low_ratio"), share("high_motion").alias("high_ratio"),
    )


def frame_summary(motion: DataFrame, keys: Sequence[str] = ("source_video", "pen_id", "frame")) -> DataFrame:
    return motion.groupBy(*keys).agg(
        F.count_distinct("track_id").alias("tracks"), F.avg("conf").alias("mean_conf"), F.sum("movement").alias("movement_total"), F.avg("movement").alias("movement_mean"), F.max("movement").alias("max_movement"),
        F.avg("area").alias("area_mean"), F.avg("center_x").alias("center_x_mean"), F.coalesce(F.stddev_samp("center_x"), F.lit(0.0)).alias("center_x_std"),
    )


def pen_summary(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    a = frames.groupBy("source_video", "pen_id").agg(F.count("*").alias("frames"), F.avg("tracks").alias("mean_tracks"), F.sum("movement_total").alias("movement_total"))
    b = tracks.groupBy("source_video", "pen_id").agg(F.count("*").alias("tracks"), F.avg("coverage").alias("mean_coverage"), F.avg("low_ratio").alias("mean_low_ratio"))
    return a.join(b, ["source_video", "pen_id"], "left")


def activity_form(frames: DataFrame, base: str = "2000-01-01 00:00:00") -> DataFrame:
    """Frames of a tracker in the schema of annotated activity: pen digits, a time line from `base`, square spans."""
    side = F.sqrt("area_mean")
    return frames.select(F.regexp_extract("pen_id", r"(\d+)", 1).try_cast("long").alias("pen"), (F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("frame").cast("decimal(18,6)"))).alias("datetime"), F.col("tracks").alias("annotations"), F.col("center_x_mean"), side.alias("span_x_mean"), side.alias("span_y_mean"))


def yolo_labels(boxes: DataFrame, classes: DataFrame) -> DataFrame:
    """Class number and box as fractions of the image; unknown classes have a null number."""
    # One row for each class.
    joined = boxes.join(F.broadcast(classes), "label", "left")
    return joined.select("label", "class_id", *[(F.col(c) / F.col(s)).alias(n) for n, c, s in (("cx", "center_x", "frame_width"), ("cy", "center_y", "frame_height"), ("bw", "w", "frame_width"), ("bh", "h", "frame_height"))])


def paired_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths of two sides by their stem; where none fits, by a base name that is the right side's only one. left, right: path and stem."""
    base = F.regexp_extract("stem", r"([^/]*)$", 1)
    exact = left.join(right.select("stem", F.col("path").alias("right_path")), "stem", "left")
    single = right.withColumn("base", base).groupBy("base").agg(F.count("*").alias("k"), F.min("path").alias("_only")).where("k = 1").drop("k")
    found = exact.withColumn("base", base).join(single, "base", "left")
    return found.select("path", F.coalesce("right_path", "_only").alias("right_path"), F.when(F.col("right_path").isNotNull(), "stem").when(F.col("_only").isNotNull(), "base").otherwise("none").alias("matched_by"))


def profile(rows: DataFrame, sets: Sequence[Sequence[str]], count: Mapping[str, Column]) -> DataFrame:
    """Counts over several groupings in one pass. sets: groups of column names; a column outside a row's group is null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    aggs = [F.count("*").alias("n"), *[c.alias(k) for k, c in count.items()], F.grouping_id().cast("long").alias("grouping")]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*aggs)


def window_features(rows: DataFrame, keys: Sequence[str], axes: Sequence[str], label: str, order: str) -> DataFrame:
    """Mean, std, minimum and maximum of each axis and of the magnitude, the first label and rows of each window."""
    magnitude = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(c), F.lit(2)) for c in axes]))
    part = rows.withColumn("magnitude", magnitude)
    fs = (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    return part.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in (*axes, "magnitude") for n, f in fs], F.min_by(label, order).alias("label"), F.count("*").alias("rows"))


def animal_hours(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pig_id", "day", "hour").agg(F.sum("movement").alias("movement"))


def animal_days(hours: DataFrame, night: Sequence[int] = (22, 23, 0, 1, 2, 3, 4, 5), least_hours: int = 20) -> DataFrame:
    """Total, mean and std of hours, distinct hours, share at night, and whether too few hours are there."""
    n = F.count_distinct("hour")
    return hours.groupBy("pig_id", "day").agg(F.sum("movement").alias("total"), F.avg("movement").alias("mean"), F.stddev_samp("movement").alias("std"), n.alias("hours"), F.try_divide(F.sum(F.when(F.col("hour").isin(*night), F.col("movement")).otherwise(0.0)), F.sum("movement")).alias("night_share"), (n < least_hours).alias("low_data"))


def challenge_days(temperature: DataFrame, clinical: DataFrame, viral: DataFrame, treatments: DataFrame, keys: Sequence[str] = ("pig_id", "day")) -> DataFrame:
    """One row for each animal and day of any table; treated where a treatment exists."""
    joined = temperature.join(clinical, list(keys), "full_outer").join(viral, list(keys), "full_outer")
    treated = treatments.select(*keys).distinct().withColumn("_t", F.lit(True))
    return joined.join(treated, list(keys), "left").withColumns({"treated": F.coalesce("_t", F.lit(False)), "symptomatic": F.coalesce(F.col("clinical") > 0, F.lit(False)), "viral_positive": F.coalesce(F.col("viral") > 0, F.lit(False))}).drop("_t")


def daily_cohort(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.groupBy("day").agg(F.count_distinct("pig_id").alias("pigs"), F.count_if("symptomatic").alias("symptomatic"), F.count_if(F.col("rectal_temperature") >= threshold).alias("rule_positive"), F.count_if("viral_positive").alias("viral_positive"), F.avg("rectal_temperature").alias("mean_temperature"), F.max("rectal_temperature").alias("max_temperature"))


def animal_timeline(rows: DataFrame, threshold: float) -> DataFrame:
    """First days of symptom, rule and virus, the lag between rule and symptom, and the highest temperature."""
    first = lambda c: F.min(F.when(c, F.col("day")))
    symptom, rule, virus = first(F.col("symptomatic")), first(F.col("rectal_temperature") >= threshold), first(F.col("viral_positive"))
    return rows.groupBy("pig_id").agg(*[c.cast("double").alias(n) for n, c in (("first_symptom", symptom), ("first_rule", rule), ("first_virus", virus), ("rule_lag", rule - symptom))], F.max("rectal_temperature").alias("max_temperature"), F.count("*").alias("days"))


def long_form(wide: DataFrame, key: str, value: str) -> DataFrame:
    """A table with a column for each animal as rows; what is no number goes."""
    names = [c for c in wide.columns if c != key]
    return wide.select(key, *[F.col(f"`{c}`").cast("string").alias(c) for c in names]).unpivot([key], names, "pig_id", "_v").select(key, "pig_id", F.col("_v").try_cast("double").alias(value)).dropna(subset=[value])
