"""Review logs of incidents: templates, carry-over, decisions, summaries, feedback on rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penlight.operators.quality import flag

# Review columns and their defaults, and states.
REVIEW = {"review_status": "pending", "confirmed": None, "false_alarm": None, "actual_cause": "", "resolved_at": "", "operator_note": "", "reviewed_by": "", "reviewed_at": "", "followup_required": None, "followup_action": ""}
BOOLEANS = ("confirmed", "false_alarm", "followup_required")
PENDING, CONFIRMED, FALSE_ALARM, NEEDS_DATA = "pending", "confirmed", "false_alarm", "needs_data"


def default(c: str) -> Column:
    return F.lit(REVIEW[c]).cast("boolean" if c in BOOLEANS else "string")


def template(incidents: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Incidents with empty review columns; lacking incident columns are an error."""
    lacking = [c for c in columns if c not in incidents.columns]
    if lacking:
        raise ValueError(f"incident columns are missing: {', '.join(lacking)}")
    return incidents.select(*columns, *[default(c).alias(c) for c in REVIEW])


def merged(log: DataFrame | None, incidents: DataFrame, columns: Sequence[str], key: str = "incident_id") -> DataFrame:
    """The log brought up to date: known incidents keep their review, new ones are pending, old ones stay."""
    fresh = template(incidents, columns)
    if log is None:
        return fresh
    old = log.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in [*[c for c in columns if c != key], *REVIEW]], F.lit(True).alias("_old"))
    new = incidents.select(*columns).withColumn("_new", F.lit(True))
    both = new.join(old, key, "full_outer")
    kept = [F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) if c != key else F.col(key) for c in columns]
    review = [F.when(F.col("_old"), F.col(f"_{c}")).otherwise(default(c)).alias(c) for c in REVIEW]
    return both.select(*kept, *review)


def decided(log: DataFrame, decisions: DataFrame, key: str = "incident_id") -> DataFrame:
    """The log after decisions (incident_id, decision, resolved_at, reviewed_by, sequence): the last valid one of each incident wins."""
    word = F.lower(F.trim("decision"))
    last = decisions.where(word.isin("confirmed", "dismissed")).groupBy(key).agg(F.max_by(F.struct(word.alias("d"), F.col("resolved_at").alias("at"), F.coalesce(F.nullif("reviewed_by", F.lit("")), F.lit("dashboard_operator")).alias("by")), "sequence").alias("_l"))
    joined = log.join(last, key, "left")
    yes, some = F.col("_l.d") == "confirmed", F.col("_l").isNotNull()
    new = {"review_status": F.when(yes, CONFIRMED).otherwise(FALSE_ALARM), "confirmed": yes, "false_alarm": ~yes, "resolved_at": F.col("_l.at"), "reviewed_by": F.col("_l.by"), "reviewed_at": F.col("_l.at")}
    return joined.withColumns({c: F.when(some, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_l")


def skipped(log: DataFrame, decisions: DataFrame, key: str = "incident_id") -> DataFrame:
    """Decisions on incidents that the log does not have."""
    return decisions.join(log.select(key), key, "left_anti")


def single(log: DataFrame, incident_id: str, decision: str, by: str | None = None, at: str | None = None) -> DataFrame:
    """One decision; an unknown incident is an error."""
    if log.where(F.col("incident_id") == incident_id).isEmpty():
        raise KeyError(incident_id)
    row = log.sparkSession.createDataFrame([(incident_id, decision, at or "", by or "", 1)], "incident_id string, decision string, resolved_at string, reviewed_by string, sequence int")
    return decided(log, row)


def outcomes() -> dict[str, Column]:
    status = F.coalesce("review_status", F.lit(PENDING))
    yes = F.coalesce(flag(F.col("confirmed").cast("string")), F.lit(False)) | (status == CONFIRMED)
    no = F.coalesce(flag(F.col("false_alarm").cast("string")), F.lit(False)) | (status == FALSE_ALARM)
    return {"status": status, "yes": yes, "no": no}


def summary(log: DataFrame) -> DataFrame:
    """Outcomes over all incidents and by queue."""
    o = outcomes()
    scope = F.when(F.grouping("queue") == 1, "all").otherwise(F.col("queue"))
    return log.rollup("queue").agg(
        scope.alias("scope"), F.count("*").alias("incidents"), F.count_if(o["status"] != PENDING).alias("reviewed"), F.count_if(o["status"] == PENDING).alias("pending"), F.count_if(o["yes"]).alias("confirmed"), F.count_if(o["no"]).alias("false_alarm"),
        F.count_if(o["status"] == NEEDS_DATA).alias("needs_data"), F.try_divide(F.count_if(o["yes"]), F.count_if(o["yes"] | o["no"])).alias("precision_estimate"), F.count_if(F.coalesce(flag(F.col("followup_required").cast("string")), F.lit(False))).alias("followup_required"),
    ).drop("queue")


def rule_feedback(log: DataFrame, rules: DataFrame) -> DataFrame:
    """Outcomes of every rule named in an incident's reason, if the rule is of the incident's queue, with advice. rules: rule_id, category."""
    o = outcomes()
    tokens = F.array_distinct(F.regexp_extract_all("reason", F.lit(r"\b([A-Za-z0-9_]+)\b"), F.lit(1)))
    rows = log.select("incident_id", "queue", o["status"].alias("s"), o["yes"].alias("y"), o["no"].alias("n"), F.explode(tokens).alias("rule_id"))
    # The rule table has some dozen rows.
    named = rows.join(F.broadcast(rules.select("rule_id", F.col("category").alias("queue"))), ["rule_id", "queue"])
    found = named.groupBy("rule_id").agg(F.count_distinct("incident_id").alias("incidents"), F.count_if(F.col("s") != PENDING).alias("reviewed"), F.count_if("y").alias("confirmed"), F.count_if("n").alias("false_alarm"), F.count_if(F.col("s") == NEEDS_DATA).alias("needs_data"))
    out = rules.join(found.hint("merge"), "rule_id", "left").na.fill(0, ["incidents", "reviewed", "confirmed", "false_alarm", "needs_data"])
    decisions = F.col("confirmed") + F.col("false_alarm")
    wrong, right = F.try_divide(F.col("false_alarm"), decisions), F.try_divide(F.col("confirmed"), decisions)
    advice = F.when(F.col("reviewed") < 3, "collect_more_reviews").when(wrong >= 0.6, "tighten_threshold").when(right >= 0.8, "keep_or_relax_carefully").when(F.col("needs_data") > 0, "improve_data_capture").otherwise("monitor")
    return out.withColumns({"false_alarm_rate": wrong, "confirmed_rate": right, "recommendation": advice})


def append_history(rows: DataFrame, path: str) -> None:
    """Appends a summary with the time of the snapshot."""
    rows.withColumn("snapshot_at", F.current_timestamp()).write.mode("append").parquet(path)
