"""Alert tracks, rollups, action queues and incidents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penlight.operators import histories
from penlight.operators.quality import has_token
from penlight.operators.rules import MODEL_CAP, MODEL_WEIGHT, tier

CATEGORIES = ("disease", "management", "environment")
# Recommended actions by queue; the first whose rule ids all stand in the reason counts.
ACTIONS = {
    "disease": (((), "recheck the animals and their temperature, call the vet"), (("rectal_temp_high",), "check animals with fever, watch symptoms, decide on isolation, call the vet")),
    "management": (((), "check feeding and water equipment and changes of care"), (("water_drop",), "check drinkers, pressure, lines and leaks"), (("feed_drop",), "check feeders, feed left, schedule and causes of low intake")),
    "environment": (
        ((), "check climate, gas and ventilation sensors and equipment"),
        (("ventilation_low",), "check fans, controller, inlets and settings"),
        (("nh3_high",), "check NH3, manure and ventilation"),
        (("co2_high",), "check CO2, fans and inlets"),
        (("co2_high", "nh3_high"), "raise ventilation, recheck CO2 and NH3 sensors, manure and ventilation equipment"),
        (("barn_temp_high",), "check heat stress, cooling, ventilation, sensors and cameras"),
    ),
}
QUEUE_ORDER = ("priority_rank", F.desc, F.desc, F.desc)


def activity_track(windows: DataFrame, threshold: float) -> DataFrame:
    """Model-only windows on the scale of the alert tracks."""
    ratio = F.try_divide(F.col("reconstruction_error"), F.lit(threshold))
    part = MODEL_WEIGHT * F.when(ratio > MODEL_CAP, MODEL_CAP).otherwise(ratio)
    confirmed = F.coalesce("confirmed_anomaly", F.lit(False))
    return windows.select(
        F.lit("activity").alias("track"), "source_dataset", "chamber_id", "start_datetime", "end_datetime",
        part.alias("model_component"), F.lit(0.0).alias("rule_component"), part.alias("track_score"), F.lit(0.0).alias("management_score"), F.lit(0.0).alias("environment_score"),
        F.when(confirmed, "disease").otherwise("").alias("alert_category"), confirmed.alias("model_anomaly"), F.lit(False).alias("rule_anomaly"), tier(part).alias("tier"),
        F.when(confirmed, "model reconstruction error above threshold (activity)").otherwise("").alias("reason"), F.coalesce("low_confidence", F.lit(False)).alias("low_confidence"),
    )


def final_table(tracks: Sequence[DataFrame]) -> DataFrame:
    """All tracks with final_alert and operational_alert."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tracks)
    final = F.coalesce("model_anomaly", F.lit(False)) | F.coalesce("rule_anomaly", F.lit(False))
    high = (F.coalesce("management_score", F.lit(0.0)) >= 0.6) | (F.coalesce("environment_score", F.lit(0.0)) >= 0.8)
    return both.withColumns({"final_alert": final, "operational_alert": final | high})


def weighted_tracks(table: DataFrame, weights: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """One score over tracks for each chamber and window; off unless asked for."""
    return table.groupBy(*keys).agg(reduce(lambda a, b: a + b, [F.coalesce(F.max(F.when(F.col("track") == t, F.col("track_score"))), F.lit(0.0)) * w for t, w in weights.items()]).alias("cross_track_score"))


def chamber_rollup(table: DataFrame) -> DataFrame:
    return table.groupBy("track", "source_dataset", "chamber_id").agg(
        F.count("*").alias("windows"),
        F.avg("track_score").alias("mean_score"),
        F.max("track_score").alias("max_score"),
        F.count_if("final_alert").alias("alert_windows"),
        F.count_if("operational_alert").alias("operational_alert_windows"),
        F.count_if(F.col("tier") == "high").alias("high_tier_windows"),
        F.bool_or("low_confidence").alias("low_confidence"),
        tier(F.max("track_score")).alias("chamber_tier"),
    )


def by_category(alerts: DataFrame, category: str = "final") -> DataFrame:
    """final, operational, or the rows whose comma list holds the category."""
    if category in ("final", "operational"):
        names = ("operational_alert", "final_alert") if category == "operational" else ("final_alert",)
        known = next((n for n in names if n in alerts.columns), None)
        return alerts.where(known) if known else alerts
    if "alert_category" not in alerts.columns:
        return alerts.limit(0)
    return alerts.where(has_token(F.col("alert_category"), category))


def priority(queue: Column) -> Column:
    """rank and name."""
    pair = lambda rank, name: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"))
    track, care, climate = (F.coalesce(c, F.lit(0.0)) for c in ("track_score", "management_score", "environment_score"))
    disease = F.when((F.col("tier") == "high") | (track >= 1.5), pair(1, "urgent")).when(track >= 1.0, pair(2, "high")).otherwise(pair(3, "watch"))
    environment = F.when(climate >= 1.2, pair(1, "urgent")).otherwise(pair(2, "high"))
    management = F.when(care >= 0.8, pair(2, "high")).otherwise(pair(3, "watch"))
    return F.when(queue == "disease", disease).when(queue == "environment", environment).when(queue == "management", management).otherwise(pair(4, "review"))


def action(queue: Column) -> Column:
    out = F.lit("check on site")
    for category, steps in ACTIONS.items():
        said = F.lit(steps[0][1])
        for tokens, text in steps[1:]:
            said = F.when(reduce(lambda a, b: a & b, [F.contains(F.coalesce("reason", F.lit("")), F.lit(t)) for t in tokens]), text).otherwise(said)
        out = F.when(queue == category, said).otherwise(out)
    return out


def action_queue(alerts: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """One row for each alert and category, with priority and action."""
    held = F.array_compact(F.array(*[F.when(has_token(F.col("alert_category"), c), F.lit(c)) for c in categories]))
    rows = alerts.withColumn("queue", F.explode(held)).withColumn("_p", priority(F.col("queue")))
    return rows.select("queue", F.col("_p.rank").alias("priority_rank"), F.col("_p.name").alias("priority"), "track", "source_dataset", "chamber_id", "start_datetime", "end_datetime", "track_score", "management_score", "environment_score", "tier", "reason", action(F.col("queue")).alias("recommended_action"))


def ordered_queue(queue: DataFrame, ties: Sequence[str] = ("chamber_id", "queue")) -> DataFrame:
    return queue.orderBy("priority_rank", F.desc("track_score"), F.desc("environment_score"), F.desc("management_score"), "start_datetime", *ties)


def incident_queue(queue: DataFrame, gap_hours: int = 6) -> DataFrame:
    """Windows of one queue, chamber and reason as incidents: a window starts a new one if it begins more than the gap after all ends before it.

    A null start or end never opens an incident. incident_key is stable over runs;
    incident_id counts by queue in order of priority.
    """
    keys = ["queue", "chamber_id", "reason"]
    order = ["start_datetime", "end_datetime", "track_score", "management_score", "environment_score"]
    ends = histories.running(queue, F.col("end_datetime"), F.max, keys, order, "_before", inclusive=False)
    late = F.coalesce(F.col("start_datetime") > F.col("_before") + F.make_dt_interval(hours=F.lit(gap_hours)), F.lit(False))
    # Of windows equal in the whole order, the first alone may be late: what ends before them keeps that order.
    rows = histories.running(ends, late.cast("int"), F.sum, keys, [*order, "_before"], "_no", inclusive=True)
    sorted_set = lambda c: F.array_join(F.array_sort(F.filter(F.collect_set(c), lambda x: x != "")), ",")
    found = rows.groupBy(*keys, "_no").agg(
        F.min("priority_rank").alias("priority_rank"),
        F.min_by("priority", "priority_rank").alias("priority"),
        sorted_set("track").alias("track"),
        sorted_set("source_dataset").alias("source_dataset"),
        F.min("start_datetime").alias("incident_start_datetime"),
        F.max("end_datetime").alias("incident_end_datetime"),
        F.count("*").alias("window_count"),
        *[F.max(f"{c}_score").alias(f"max_{c}_score") for c in ("track", "management", "environment")],
        sorted_set("tier").alias("tier"),
        F.min("recommended_action").alias("recommended_action"),
    )
    return found.drop("_no").withColumn("incident_key", F.xxhash64("queue", "chamber_id", "reason", "incident_start_datetime"))


def numbered_incidents(incidents: DataFrame) -> DataFrame:
    """Adds incident_id: the queue and a number in order of priority, at least four digits.

    A queue falls into steps of its leading order (rank, then track and environment score in
    twentieths); incidents are numbered inside a step, and the steps before are added up.
    """
    part = F.struct("priority_rank", F.coalesce(-F.floor(F.col("max_track_score") * 20), F.lit(2**40)).alias("track"), F.coalesce(-F.floor(F.col("max_environment_score") * 20), F.lit(2**40)).alias("environment"))
    rows = incidents.withColumn("_step", part)
    steps = rows.groupBy("queue", "_step").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("queue").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    starts = steps.select(F.col("queue").alias("_q"), F.col("_step").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    best = Window.partitionBy("queue", "_step").orderBy(F.desc("max_track_score"), F.desc("max_environment_score"), F.desc("max_management_score"), "incident_start_datetime", "chamber_id", "reason")
    local = rows.withColumn("_i", F.row_number().over(best)).join(starts.hint("merge"), F.col("queue").eqNullSafe(F.col("_q")) & (F.col("_step") == F.col("_s")))
    no = (F.col("_start") + F.col("_i")).cast("string")
    return local.select(*incidents.columns, no.alias("_no")).withColumn("incident_id", F.concat_ws("-", "queue", F.lpad("_no", F.greatest(F.lit(4), F.length("_no")), F.lit("0")))).drop("_no")


def peer_comparison(rollup: DataFrame, group: str = "source_dataset") -> DataFrame:
    """Each chamber against its building: mean of maxima, difference, rank."""
    peers = Window.partitionBy(group)
    return rollup.withColumns({"building_mean": F.avg("max_score").over(peers), "delta": F.col("max_score") - F.avg("max_score").over(peers), "building_rank": F.row_number().over(peers.orderBy(F.desc("max_score"), "chamber_id"))})


def stage(track: Column, care: Column, climate: Column) -> Column:
    """The operator's stage from scores: act, check, watch or normal."""
    return F.when((track >= 1.5) | (climate >= 1.2), "act").when((track >= 0.8) | (care >= 0.8) | (climate >= 0.8), "check").when((track > 0) | (care > 0) | (climate > 0), "watch").otherwise("normal")


def incident_view(incidents: DataFrame) -> DataFrame:
    """Incidents for the operator: score of the own queue, reasons as a list without repeats, stage."""
    own = F.when(F.col("queue") == "disease", F.col("max_track_score")).when(F.col("queue") == "management", F.col("max_management_score")).otherwise(F.col("max_environment_score"))
    parts = F.array_distinct(F.filter(F.transform(F.split("reason", r"[,|]"), F.trim), lambda x: x != ""))
    return incidents.select("queue", "chamber_id", "incident_start_datetime", own.alias("score"), F.array_join(parts, ";").alias("reason_parts"), stage(F.col("max_track_score"), F.col("max_management_score"), F.col("max_environment_score")).alias("stage"))
