"""Comparisons and rollups over several tables: rule sets, daily timelines, activity, quality flags, performance rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penlight.operators import rules
from penlight.operators.events import HORIZONS, alerts_before
from penlight.operators.series import drop_features

COUNTS = ("observations", "anomalies", "disease_alerts", "management_alerts", "environment_alerts")


def rule_set_rows(windows: DataFrame, sets: Mapping[str, Sequence[Mapping]], keys: Sequence[str]) -> DataFrame:
    """Every window under every rule set: keys, rule_set, reasons, score and alerts. All sets are expressions over one pass of the windows."""
    def scored(name: str, some: Sequence[Mapping]):
        found = rules.scores({r["id"]: rules.hit(r, windows.columns) for r in some}, some)
        names = ("rule_reasons", "rule_score", "rule_observation", "rule_anomaly", *[f"{c}_rule_anomaly" for c in rules.CATEGORY_LIMITS])
        return F.struct(F.lit(name).alias("rule_set"), *[found[n].alias(n) for n in names])

    return windows.select(*keys, F.explode(F.array(*[scored(n, s) for n, s in sets.items()])).alias("s")).select(*keys, "s.*")


def rule_sets_compared(rows: DataFrame, baseline: str = "baseline") -> DataFrame:
    """A row for each rule set: windows, observations, alerts by category, scores, and the change of counts against the baseline."""
    found = rows.groupBy("rule_set").agg(
        F.count("*").alias("windows"), F.count_if("rule_observation").alias("observations"), F.count_if("rule_anomaly").alias("anomalies"),
        *[F.count_if(f"{c}_rule_anomaly").alias(f"{c}_alerts") for c in rules.CATEGORY_LIMITS], F.avg("rule_score").alias("mean_score"), F.max("rule_score").alias("max_score"),
    )
    base = found.where(F.col("rule_set") == baseline).select(*[F.col(c).alias(f"_{c}") for c in COUNTS])
    # One row of the baseline.
    return found.join(F.broadcast(base)).withColumns({f"{c}_delta": F.col(c) - F.col(f"_{c}") for c in COUNTS}).drop(*[f"_{c}" for c in COUNTS])


def lead_by_set(events: DataFrame, alerts: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """A row for each rule set: its alert windows, events that one of them preceded, mean lead hours of the first, and recall by horizon.

    alerts: rule_set, chamber_id, start_datetime.
    """
    best = alerts_before(events, alerts, max(horizons), ["rule_set"])
    caught = best.groupBy("rule_set").agg(F.count("*").alias("matched"), F.avg("first_lead_hours").alias("mean_first_lead_hours"), *[F.count_if(F.col("least_lead_hours") <= h).alias(f"_{h}") for h in horizons])
    sizes = alerts.groupBy("rule_set").agg(F.count("*").alias("alert_windows"))
    # A row for each rule set, and one of the number of events.
    joined = sizes.join(F.broadcast(caught), "rule_set", "left").join(F.broadcast(events.agg(F.count("*").alias("events"))))
    recall = [F.try_divide(F.coalesce(f"_{h}", F.lit(0)), F.col("events")).alias(f"recall_{h}h") for h in horizons]
    return joined.select("rule_set", "alert_windows", "events", F.coalesce("matched", F.lit(0)).alias("lead_matched_events"), "mean_first_lead_hours", *recall)


def raw_values(rows: DataFrame, raw: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of a split or a scaled table with the values that the raw table has for their keys (null where it has none)."""
    return rows.select(*keys).join(raw.select(*keys, *columns), list(keys), "left")


def daily_timeline(tables: Sequence[DataFrame], treatments: DataFrame, keys: Sequence[str] = ("pig_id", "day")) -> DataFrame:
    """One row for each animal and day of any of several daily tables; treated where a treatment exists."""
    joined = reduce(lambda a, b: a.join(b, list(keys), "full_outer"), tables)
    treated = treatments.select(*keys).distinct().withColumn("_t", F.lit(True))
    return joined.join(treated, list(keys), "left").withColumn("treated", F.coalesce("_t", F.lit(False))).drop("_t")


def with_quality_flags(windows: DataFrame, flags: DataFrame, keys: Sequence[str], flag: str = "low_confidence") -> DataFrame:
    """Windows with their entity's quality flag; false where the entity has none."""
    known = flags.groupBy(*keys).agg(F.bool_or(flag).alias(flag))
    return windows.join(known, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def animal_rollup(hours: DataFrame) -> DataFrame:
    """Per animal: days, hours, total, mean and largest hour."""
    return hours.groupBy("pig_id").agg(F.count_distinct("day").alias("days"), F.count("*").alias("hours"), F.sum("movement").alias("total"), F.avg("movement").alias("mean"), F.max("movement").alias("largest"))


def pig_days(hours: DataFrame) -> DataFrame:
    """One row: days on which an animal was seen, days possible (animals times days), and their share."""
    days_seen = hours.select("pig_id", "day").distinct()
    found = days_seen.agg(F.count("*").alias("observed"), (F.count_distinct("pig_id") * F.count_distinct("day")).alias("possible"))
    return found.withColumn("coverage", F.try_divide(F.col("observed"), F.col("possible")))


def largest_drops(days_of: DataFrame, most: int = 5) -> DataFrame:
    """The days of the largest fall of an animal's total against its day before; the number is the report's."""
    rows = drop_features(days_of, "total", ["pig_id"], "day")
    return rows.where("total_change is not null").orderBy("total_change", "pig_id", "day").limit(most).select("pig_id", "day", "total", "total_change")


def named_series(rows: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Columns as long series for charts: keys, series and value, without nulls. columns: name of the series -> column."""
    long = rows.select(*keys, *[F.col(c).cast("double").alias(n) for n, c in columns.items()]).unpivot(list(keys), list(columns), "series", "value")
    return long.where("value is not null")


def performance_rows(parts: Mapping[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """Metric tables as rows of one page: section, name, metric and value. parts: section -> table, column of the name, metrics."""
    rows = [df.select(F.col(name).alias("name"), *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["name"], list(metrics), "metric", "value").select(F.lit(section).alias("section"), "name", "metric", "value") for section, (df, name, metrics) in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def renamed(rows: DataFrame, columns: Mapping[str, str], time: str | None = None) -> DataFrame:
    """Only the columns of a map from raw to standard names; `time` (a standard name) is parsed, null where it is no time."""
    out = rows.select(*[F.col(a).alias(b) for a, b in columns.items() if a in rows.columns])
    return out if time is None else out.withColumn(time, F.try_to_timestamp(time).cast("timestamp_ntz"))
