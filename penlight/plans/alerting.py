"""Queries of alerts, incidents and farm events."""

from __future__ import annotations

from pyspark.sql import functions as F

from penlight.operators import alerts, events, quality
from penlight.operators.series import confirm_runs
from penlight.sources.adapters import oracle, rounded, table

CATEGORIES = ("final", "operational", "disease", "management", "environment")


def final_alerts(spark, sf_dir):
    """The alerts of disease and feeding."""
    return table(spark, sf_dir, "alerts").where("final_alert")


def union_tracks(spark, sf_dir):
    rows = table(spark, sf_dir, "alerts").drop("final_alert", "operational_alert")
    activity = rows.where("l_linenumber = 1").select("source_dataset", "chamber_id", "start_datetime", "end_datetime", (F.col("track_score") * 1.5).alias("reconstruction_error"), F.col("model_anomaly").alias("confirmed_anomaly"), "low_confidence")
    both = alerts.final_table([rows, alerts.activity_track(activity, 1.25)])
    return rounded(both.groupBy("track", "tier", "final_alert", "operational_alert").agg(F.count("*").alias("n"), F.sum("track_score").alias("score")), "score", places=4)


def chamber_rollup(spark, sf_dir):
    return rounded(alerts.chamber_rollup(table(spark, sf_dir, "alerts")), "mean_score", "max_score")


def cross_track(spark, sf_dir):
    rows = table(spark, sf_dir, "alerts").withColumn("track", F.when(F.col("l_linenumber") % 2 == 0, "barn").otherwise("activity"))
    return rounded(alerts.weighted_tracks(rows, {"barn": 0.65, "activity": 0.35}, ["chamber_id", "start_datetime"]), "cross_track_score")


def peers(spark, sf_dir):
    rollup = alerts.chamber_rollup(table(spark, sf_dir, "alerts").withColumn("track_score", F.col("track_score") + F.substring("chamber_id", 2, 2).cast("int") / 100))
    return rounded(alerts.peer_comparison(rollup).select("source_dataset", "chamber_id", "max_score", "building_mean", "delta", "building_rank"), "max_score", "building_mean", "delta")


def action_queue(spark, sf_dir):
    queue = alerts.action_queue(final_alerts(spark, sf_dir))
    return queue.select("queue", "priority_rank", "priority", "chamber_id", "start_datetime", "track_score", "reason", "recommended_action")


QUEUE = """
q AS (SELECT a.*, c.queue, CASE c.queue WHEN 'disease' THEN CASE WHEN tier = 'high' OR track_score >= 1.5 THEN 1 WHEN track_score >= 1.0 THEN 2 ELSE 3 END WHEN 'environment' THEN CASE WHEN environment_score >= 1.2 THEN 1 ELSE 2 END ELSE CASE WHEN management_score >= 0.8 THEN 2 ELSE 3 END END AS priority_rank,
  CASE c.queue WHEN 'disease' THEN CASE WHEN contains(reason, 'rectal_temp_high') THEN 'check animals with fever, watch symptoms, decide on isolation, call the vet' ELSE 'recheck the animals and their temperature, call the vet' END
    WHEN 'management' THEN CASE WHEN contains(reason, 'feed_drop') THEN 'check feeders, feed left, schedule and causes of low intake' ELSE 'check feeding and water equipment and changes of care' END
    ELSE CASE WHEN contains(reason, 'co2_high') THEN 'check CO2, fans and inlets' ELSE 'check climate, gas and ventilation sensors and equipment' END END AS recommended_action
  FROM alerts a JOIN (SELECT unnest(['disease', 'management', 'environment']) AS queue) c ON list_contains(string_split(alert_category, ','), c.queue) WHERE final_alert)"""
INCIDENTS = QUEUE + """,
o AS (SELECT *, max(end_datetime) OVER (PARTITION BY queue, chamber_id, reason ORDER BY start_datetime NULLS FIRST, end_datetime NULLS FIRST, track_score NULLS FIRST, management_score NULLS FIRST, environment_score NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM q),
m AS (SELECT *, sum(CASE WHEN start_datetime > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY queue, chamber_id, reason ORDER BY start_datetime NULLS FIRST, end_datetime NULLS FIRST, track_score NULLS FIRST, management_score NULLS FIRST, environment_score NULLS FIRST, before NULLS FIRST ROWS UNBOUNDED PRECEDING) AS no FROM o),
incidents AS (SELECT queue, chamber_id, reason, min(priority_rank) AS priority_rank, min(start_datetime) AS incident_start_datetime, max(end_datetime) AS incident_end_datetime, count(*) AS window_count, max(track_score) AS max_track_score, max(management_score) AS max_management_score, max(environment_score) AS max_environment_score, string_agg(DISTINCT tier, ',' ORDER BY tier) AS tier FROM m GROUP BY queue, chamber_id, reason, no)"""


def incidents_of(spark, sf_dir):
    return alerts.incident_queue(alerts.action_queue(final_alerts(spark, sf_dir)))


def incidents(spark, sf_dir):
    return incidents_of(spark, sf_dir).select("queue", "chamber_id", "reason", "priority_rank", "incident_start_datetime", "incident_end_datetime", "window_count", "max_track_score", "max_management_score", "max_environment_score", "tier")


def incident_numbers(spark, sf_dir):
    rows = alerts.numbered_incidents(incidents_of(spark, sf_dir))
    return rows.select("incident_id", "queue", "chamber_id", "reason", "incident_start_datetime")


def incident_view(spark, sf_dir):
    return alerts.incident_view(incidents_of(spark, sf_dir))


def top_alerts(spark, sf_dir):
    """A report of the ten first alerts in priority order."""
    queue = alerts.action_queue(final_alerts(spark, sf_dir).withColumn("track", F.concat("l_orderkey", F.lit("/"), "l_linenumber")))
    return alerts.ordered_queue(queue, ["chamber_id", "queue", "track"]).limit(10).select("queue", "priority_rank", "chamber_id", "start_datetime", "track")


def filters(spark, sf_dir):
    rows = table(spark, sf_dir, "alerts")
    tagged = [alerts.by_category(rows, c).agg(F.lit(c).alias("category"), F.count("*").alias("n")) for c in CATEGORIES]
    return tagged[0].union(tagged[1]).union(tagged[2]).union(tagged[3]).union(tagged[4])


def distinct_windows(spark, sf_dir):
    return final_alerts(spark, sf_dir).select("chamber_id", "start_datetime", "end_datetime").distinct()


def confirmed(spark, sf_dir):
    rows = table(spark, sf_dir, "alerts").withColumn("flag", F.coalesce("model_anomaly", F.lit(False)))
    found = confirm_runs(rows, "flag", ["chamber_id"], ["start_datetime", "l_orderkey", "l_linenumber", "flag"], 3)
    return found.groupBy("chamber_id").agg(F.count_if("flag").alias("raw"), F.count_if("confirmed").alias("confirmed"))


def new_alerts(spark, sf_dir):
    rows = table(spark, sf_dir, "alerts")
    return events.new_alerts(rows.where("operational_alert"), rows.where("final_alert"), ["chamber_id", "start_datetime"]).select("chamber_id", "start_datetime", "l_orderkey", "l_linenumber")


def reason_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "alerts")
    both = rows.where("final_alert").select("reason", F.lit(True).alias("a")).unionByName(rows.where("operational_alert").select("reason", F.lit(False).alias("a")))
    return both.groupBy("reason").agg(F.count_if("a").alias("baseline"), F.count_if(~F.col("a")).alias("candidate")).withColumn("delta", F.col("candidate") - F.col("baseline"))


def event_overlaps(spark, sf_dir):
    rows, found = table(spark, sf_dir, "farm_events"), final_alerts(spark, sf_dir)
    spans = rounded(events.overlap_spans(rows, found), "overlap_hours")
    return events.expanded(spans, rows, events.overlap_days("event")).select("event_id", "chamber_id", "event_start", "alert_start", "track_score", "reason", "overlap_hours")


def lead_matches(spark, sf_dir):
    rows, found = table(spark, sf_dir, "farm_events"), final_alerts(spark, sf_dir)
    spans = rounded(events.lead_spans(rows, found), "lead_hours")
    return events.expanded(spans, rows, events.lead_days()).select("event_id", "chamber_id", "event_start", "alert_start", "track_score", "reason", "lead_hours", "matched_horizons_hours")


def lead_summary(spark, sf_dir):
    return rounded(events.lead_summary(table(spark, sf_dir, "farm_events"), final_alerts(spark, sf_dir)), "first_lead_hours", "max_track_score")


def lead_metrics(spark, sf_dir):
    found = events.lead_metrics(table(spark, sf_dir, "farm_events"), final_alerts(spark, sf_dir))
    return rounded(found, "mean_first_lead_hours", "max_first_lead_hours", "recall_24h", "recall_48h", "recall_72h", "precision_proxy")


def category_lead(spark, sf_dir):
    found = events.category_lead_metrics(table(spark, sf_dir, "farm_events"), table(spark, sf_dir, "alerts"), CATEGORIES)
    return rounded(found, "recall_24h", "recall_48h", "recall_72h")


LEAD = """
f AS (SELECT * FROM alerts WHERE final_alert),
l AS (SELECT e.event_id, e.chamber_id, e.event_type, e.start_datetime AS event_start, f.start_datetime AS alert_start, f.end_datetime AS alert_end, f.track_score, f.reason, epoch(e.start_datetime - f.start_datetime) / 3600.0 AS lead_hours
  FROM farm_events e JOIN f ON e.chamber_id = f.chamber_id AND f.start_datetime BETWEEN e.start_datetime - INTERVAL 72 HOUR AND e.start_datetime)"""
LEAD_EVENTS = LEAD + """,
g AS (SELECT event_id, count(*) AS n, min(alert_start) AS first_alert_start, max(lead_hours) AS first_lead_hours, max(track_score) AS max_track_score, min(lead_hours) AS least FROM l GROUP BY 1),
s AS (SELECT e.event_id, e.chamber_id, e.event_type, e.start_datetime AS event_start, e.severity, first_alert_start, round(first_lead_hours, 6) AS first_lead_hours, round(max_track_score, 6) AS max_track_score, coalesce(n, 0) AS lead_alert_count, coalesce(least <= 24, false) AS caught_within_24h, coalesce(least <= 48, false) AS caught_within_48h, coalesce(least <= 72, false) AS caught_within_72h
  FROM farm_events e LEFT JOIN g USING (event_id))"""


def dirty_events(spark, sf_dir):
    rows = table(spark, sf_dir, "farm_events").withColumn("n", F.col("event_id").cast("long"))
    return rows.select(
        F.when(F.col("n") % 50 == 0, "").when(F.col("n") % 40 == 1, "7").otherwise(F.concat(F.lit(" "), "event_id")).alias("event_id"), "farm_id", F.when(F.col("n") % 30 != 0, F.col("chamber_id")).alias("chamber_id"),
        F.when(F.col("n") % 20 == 0, "flood").otherwise(F.col("event_type")).alias("event_type"), F.when(F.col("n") % 25 == 0, "soon").otherwise(F.col("start_datetime").cast("string")).alias("start_datetime"),
        F.when(F.col("n") % 35 == 0, F.lit("1990-01-01 00:00:00")).otherwise(F.col("end_datetime").cast("string")).alias("end_datetime"), F.when(F.col("n") % 45 == 0, "high").otherwise((F.col("severity") + F.col("n") % 3).cast("string")).alias("severity"),
        F.when(F.col("n") % 33 == 0, "perhaps").when(F.col("vet_confirmed"), " Yes").otherwise("0").alias("vet_confirmed"), F.lit("log").alias("source"), F.lit(None).cast("string").alias("notes"), "n",
    )


def event_issues(spark, sf_dir):
    found = events.issue_rows(events.validated(dirty_events(spark, sf_dir), ["n"]))
    return found.groupBy("column", "message").agg(F.count("*").alias("n"))


def event_flags(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(x) for x in (" True", "F", "yes", "0", "x", "", "Y")]), (F.col("o_custkey") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(quality.flag(text).alias("strict"), quality.flag(text, unknown=False).alias("lenient"))
    return rows.groupBy("strict", "lenient").agg(F.count("*").alias("n"))


KINDS = [("fever", "disease", "target", "fever", "disease_alert"), ("feed_failure", "management", "target", "feeding", "management_alert")]


def event_kinds(spark, sf_dir):
    kinds = spark.createDataFrame(KINDS, "kind string, category string, role string, label string, target_alert string")
    mapped = events.mapped_kinds(table(spark, sf_dir, "farm_events"), kinds)
    return mapped.groupBy("event_type", "category", "role", "target_alert", "include_in_recall").agg(F.count("*").alias("n"))


def daily_alerts(spark, sf_dir):
    return table(spark, sf_dir, "alerts").groupBy("chamber_id", F.col("start_datetime").cast("date").alias("date")).agg(F.bool_or(F.col("track_score") >= 1.9).alias("alert"), F.min("reason").alias("reasons"))


def windows_before(spark, sf_dir):
    rows = table(spark, sf_dir, "farm_events").select("event_id", "chamber_id", F.col("start_datetime").alias("begin_dt"), F.col("end_datetime").alias("end_dt"))
    found = events.windows_before(rows, daily_alerts(spark, sf_dir), "chamber_id", "alert")
    return found.drop("during_reasons", "pre_24h_reasons", "pre_48h_reasons", "pre_72h_reasons")


def detection_recall(spark, sf_dir):
    kinds = spark.createDataFrame(KINDS, "kind string, category string, role string, label string, target_alert string")
    mapped = events.mapped_kinds(table(spark, sf_dir, "farm_events"), kinds).select("event_id", "category", "include_in_recall")
    found = windows_before(spark, sf_dir).join(mapped.hint("merge"), "event_id")
    return rounded(events.detection_recall(found), "during_recall", "pre_24h_recall", "pre_48h_recall", "pre_72h_recall")


DAYS = """
d AS (SELECT chamber_id, start_datetime::DATE AS date, bool_or(track_score >= 1.9) AS alert FROM alerts GROUP BY ALL),
w AS (SELECT e.event_id, e.chamber_id, e.event_type, e.start_datetime AS begin_dt, e.end_datetime AS end_dt, """ + ", ".join(
    f"count(CASE WHEN {c} THEN 1 END) AS {n}_days, coalesce(bool_or({c} AND alert), false) AS {n}_detected"
    for n, c in (("during", "d.date >= e.start_datetime::DATE"), *((f"pre_{h}h", f"d.date >= (e.start_datetime - INTERVAL {h} HOUR)::DATE AND d.date < e.start_datetime::DATE") for h in (24, 48, 72)))
) + """
  FROM farm_events e LEFT JOIN d ON d.chamber_id = e.chamber_id AND d.date BETWEEN (e.start_datetime - INTERVAL 72 HOUR)::DATE AND e.end_datetime::DATE GROUP BY ALL)"""


def robust(spark, sf_dir):
    daily = table(spark, sf_dir, "activity").groupBy("pig_id", "day").agg(F.sum("movement").alias("moved"))
    return rounded(events.robust_scores(daily, {"moved": "drop"}, "pig_id"), "moved", "moved_drop_score", places=4)


def clean_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "farm_events").select("event_id", "chamber_id", "start_datetime")
    windows = table(spark, sf_dir, "alerts").where("track_score >= 1.9")
    return events.outside_windows(rows, windows, "chamber_id", "start_datetime")


QUERIES = {
    "set01_track_union": union_tracks,
    "agg22_chamber_rollup": chamber_rollup,
    "dom05_cross_track": cross_track,
    "win19_peer_comparison": peers,
    "dom06_action_queue": action_queue,
    "win15_incidents": incidents,
    "win16_incident_numbers": incident_numbers,
    "dom18_incident_view": incident_view,
    "top01_priority_order": top_alerts,
    "prj27_alert_filters": filters,
    "set02_distinct_windows": distinct_windows,
    "win06_confirmed_runs": confirmed,
    "join12_new_alerts": new_alerts,
    "agg33_reason_compare": reason_compare,
    "join06_event_overlaps": event_overlaps,
    "join07_lead_matches": lead_matches,
    "join07_lead_summary": lead_summary,
    "agg27_lead_metrics": lead_metrics,
    "evl08_category_lead": category_lead,
    "prj25_event_issues": event_issues,
    "prj26_flags": event_flags,
    "prj28_event_kinds": event_kinds,
    "join09_windows_before": windows_before,
    "agg28_detection_recall": detection_recall,
    "win17_robust_scores": robust,
    "join08_clean_rows": clean_rows,
}
ORACLE_SQL = {
    "set01_track_union": oracle("""
WITH a AS (SELECT track, tier, track_score, coalesce(model_anomaly, false) OR coalesce(rule_anomaly, false) AS final_alert, management_score, environment_score FROM alerts UNION ALL
  SELECT 'activity', CASE WHEN p >= 1.5 THEN 'high' WHEN p >= 0.8 THEN 'medium' ELSE 'normal' END, p, model_anomaly, 0, 0 FROM (SELECT least(track_score * 1.5 / 1.25, 2.0) * 0.5 AS p, * FROM alerts WHERE l_linenumber = 1))
SELECT track, tier, final_alert, final_alert OR management_score >= 0.6 OR environment_score >= 0.8 AS operational_alert, count(*) AS n, round(sum(track_score), 4) AS score FROM a GROUP BY ALL"""),
    "agg22_chamber_rollup": oracle("SELECT track, source_dataset, chamber_id, count(*) AS windows, round(avg(track_score), 6) AS mean_score, round(max(track_score), 6) AS max_score, count_if(final_alert) AS alert_windows, count_if(operational_alert) AS operational_alert_windows, count_if(tier = 'high') AS high_tier_windows, bool_or(low_confidence) AS low_confidence, CASE WHEN max(track_score) >= 1.5 THEN 'high' WHEN max(track_score) >= 0.8 THEN 'medium' ELSE 'normal' END AS chamber_tier FROM alerts GROUP BY ALL"),
    "dom05_cross_track": oracle("SELECT chamber_id, start_datetime, round(coalesce(max(CASE WHEN l_linenumber % 2 = 0 THEN track_score END), 0) * 0.65 + coalesce(max(CASE WHEN l_linenumber % 2 = 1 THEN track_score END), 0) * 0.35, 6) AS cross_track_score FROM alerts GROUP BY ALL"),
    "win19_peer_comparison": oracle("""
WITH r AS (SELECT source_dataset, chamber_id, max(track_score + substring(chamber_id, 2, 2)::INT / 100) AS m FROM alerts GROUP BY ALL)
SELECT source_dataset, chamber_id, round(m, 6) AS max_score, round(avg(m) OVER (PARTITION BY source_dataset), 6) AS building_mean, round(m - avg(m) OVER (PARTITION BY source_dataset), 6) AS delta, row_number() OVER (PARTITION BY source_dataset ORDER BY m DESC, chamber_id)::INT AS building_rank FROM r"""),
    "dom06_action_queue": oracle("WITH " + QUEUE.strip() + " SELECT queue, priority_rank, CASE priority_rank WHEN 1 THEN 'urgent' WHEN 2 THEN 'high' ELSE 'watch' END AS priority, chamber_id, start_datetime, track_score, reason, recommended_action FROM q"),
    "win15_incidents": oracle("WITH " + INCIDENTS.strip() + " SELECT * FROM incidents"),
    "win16_incident_numbers": oracle("WITH " + INCIDENTS.strip() + " SELECT concat(queue, '-', lpad(n::VARCHAR, greatest(4, length(n::VARCHAR))::INT, '0')) AS incident_id, queue, chamber_id, reason, incident_start_datetime FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY priority_rank, max_track_score DESC, max_environment_score DESC, max_management_score DESC, incident_start_datetime, chamber_id, reason) AS n FROM incidents)"),
    "dom18_incident_view": oracle("WITH " + INCIDENTS.strip() + " SELECT queue, chamber_id, incident_start_datetime, CASE queue WHEN 'disease' THEN max_track_score WHEN 'management' THEN max_management_score ELSE max_environment_score END AS score, replace(reason, ',', ';') AS reason_parts, CASE WHEN max_track_score >= 1.5 OR max_environment_score >= 1.2 THEN 'act' WHEN max_track_score >= 0.8 OR max_management_score >= 0.8 OR max_environment_score >= 0.8 THEN 'check' WHEN max_track_score > 0 OR max_management_score > 0 OR max_environment_score > 0 THEN 'watch' ELSE 'normal' END AS stage FROM incidents"),
    "top01_priority_order": oracle("WITH " + QUEUE.strip() + " SELECT queue, priority_rank, chamber_id, start_datetime, concat(l_orderkey, '/', l_linenumber) AS track FROM q ORDER BY priority_rank, track_score DESC, environment_score DESC, management_score DESC, start_datetime, chamber_id, queue, concat(l_orderkey, '/', l_linenumber) LIMIT 10"),
    "prj27_alert_filters": oracle(" UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS n FROM alerts WHERE " + (f"{c}_alert" if c in ("final", "operational") else f"list_contains(string_split(alert_category, ','), '{c}')") for c in CATEGORIES)),
    "set02_distinct_windows": oracle("SELECT DISTINCT chamber_id, start_datetime, end_datetime FROM alerts WHERE final_alert"),
    "win06_confirmed_runs": oracle("""
WITH i AS (SELECT *, sum(CASE WHEN model_anomaly THEN 0 ELSE 1 END) OVER (PARTITION BY chamber_id ORDER BY start_datetime NULLS FIRST, l_orderkey NULLS FIRST, l_linenumber NULLS FIRST, coalesce(model_anomaly, false) ROWS UNBOUNDED PRECEDING) AS g FROM alerts),
r AS (SELECT *, count(CASE WHEN model_anomaly THEN 1 END) OVER (PARTITION BY chamber_id, g) AS size FROM i)
SELECT chamber_id, count_if(model_anomaly) AS raw, count_if(model_anomaly AND size >= 3) AS confirmed FROM r GROUP BY ALL"""),
    "join12_new_alerts": oracle("SELECT chamber_id, start_datetime, l_orderkey, l_linenumber FROM alerts a WHERE operational_alert AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE (l.l_returnflag = 'R' OR l.l_tax >= 0.06) AND concat('c', l.l_suppkey % 50) = a.chamber_id AND l.l_shipdate = a.start_datetime)"),
    "agg33_reason_compare": oracle("SELECT reason, count_if(final_alert) AS baseline, count_if(operational_alert) AS candidate, count_if(operational_alert) - count_if(final_alert) AS delta FROM alerts WHERE operational_alert GROUP BY 1"),
    "join06_event_overlaps": oracle("SELECT e.event_id, e.chamber_id, e.start_datetime AS event_start, a.start_datetime AS alert_start, track_score, reason, round(epoch(least(e.end_datetime, a.end_datetime) - greatest(e.start_datetime, a.start_datetime)) / 3600.0, 6) AS overlap_hours FROM farm_events e JOIN alerts a ON e.chamber_id = a.chamber_id AND greatest(e.start_datetime, a.start_datetime) < least(e.end_datetime, a.end_datetime) WHERE a.final_alert"),
    "join07_lead_matches": oracle("WITH " + LEAD.strip() + " SELECT event_id, chamber_id, event_start, alert_start, track_score, reason, round(lead_hours, 6) AS lead_hours, concat_ws(',', CASE WHEN lead_hours <= 24 THEN '24' END, CASE WHEN lead_hours <= 48 THEN '48' END, '72') AS matched_horizons_hours FROM l"),
    "join07_lead_summary": oracle("WITH " + LEAD_EVENTS.strip() + " SELECT * FROM s"),
    "agg27_lead_metrics": oracle("WITH " + LEAD_EVENTS.strip() + """
SELECT coalesce(event_type, 'all') AS scope, count(*) AS events, count_if(lead_alert_count > 0) AS lead_matched_events, round(avg(first_lead_hours), 6) AS mean_first_lead_hours, round(max(first_lead_hours), 6) AS max_first_lead_hours,
  round(avg(caught_within_24h::INT), 6) AS recall_24h, round(avg(caught_within_48h::INT), 6) AS recall_48h, round(avg(caught_within_72h::INT), 6) AS recall_72h, (SELECT count(*) FROM f) AS total_alert_windows, (SELECT count(*) FROM (SELECT DISTINCT chamber_id, alert_start, alert_end FROM l)) AS lead_matched_alert_windows,
  round((SELECT count(*) FROM (SELECT DISTINCT chamber_id, alert_start, alert_end FROM l)) / (SELECT count(*) FROM f)::DOUBLE, 6) AS precision_proxy FROM s GROUP BY ROLLUP (event_type)"""),
    "evl08_category_lead": oracle("""
WITH t AS (SELECT *, unnest(list_filter(['final', 'operational', 'disease', 'management', 'environment'], lambda c: CASE c WHEN 'final' THEN final_alert WHEN 'operational' THEN operational_alert ELSE list_contains(string_split(alert_category, ','), c) END)) AS filter FROM alerts),
m AS (SELECT filter, event_id, min(epoch(e.start_datetime - t.start_datetime) / 3600.0) AS least FROM farm_events e JOIN t ON e.chamber_id = t.chamber_id AND t.start_datetime BETWEEN e.start_datetime - INTERVAL 72 HOUR AND e.start_datetime GROUP BY ALL),
c AS (SELECT filter, count(*) AS k, count_if(least <= 24) AS a, count_if(least <= 48) AS b, count_if(least <= 72) AS c FROM m GROUP BY 1),
n AS (SELECT filter, count(*) AS total_alert_windows FROM t GROUP BY 1)
SELECT filter, (SELECT count(*) FROM farm_events) AS events, total_alert_windows, coalesce(k, 0) AS lead_matched_events, round(a / (SELECT count(*) FROM farm_events)::DOUBLE, 6) AS recall_24h, round(b / (SELECT count(*) FROM farm_events)::DOUBLE, 6) AS recall_48h, round(c / (SELECT count(*) FROM farm_events)::DOUBLE, 6) AS recall_72h FROM n LEFT JOIN c USING (filter)"""),
    "prj25_event_issues": oracle("""
WITH r AS (SELECT *, event_id::BIGINT AS n FROM farm_events),
x AS (SELECT n, CASE WHEN n % 50 = 0 THEN '' WHEN n % 40 = 1 THEN '7' ELSE event_id END AS id, n % 30 = 0 AS no_chamber, n % 20 = 0 AS bad_type, n % 25 = 0 AS bad_start, CASE WHEN n % 25 <> 0 THEN start_datetime END AS s, CASE WHEN n % 35 = 0 THEN TIMESTAMP '1990-01-01' ELSE end_datetime END AS e, CASE WHEN n % 45 <> 0 THEN severity + n % 3 END AS v, n % 33 = 0 AS bad_vet FROM r),
y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) > 1 AS twice FROM x),
i AS (SELECT unnest([CASE WHEN id = '' THEN 'event_id/empty' END, CASE WHEN id <> '' AND twice THEN 'event_id/duplicate' END, CASE WHEN no_chamber THEN 'chamber_id/empty' END, CASE WHEN bad_type THEN 'event_type/unknown' END, CASE WHEN bad_start THEN 'start_datetime/not a time' END, CASE WHEN e < s THEN 'end_datetime/before start' END, CASE WHEN NOT coalesce(v BETWEEN 1 AND 5, false) THEN 'severity/not from 1 to 5' END, CASE WHEN bad_vet THEN 'vet_confirmed/not true or false' END]) AS m FROM y)
SELECT split_part(m, '/', 1) AS column, split_part(m, '/', 2) AS message, count(*) AS n FROM i WHERE m IS NOT NULL GROUP BY ALL"""),
    "prj26_flags": "SELECT [true, false, true, false, NULL, NULL, true][o_custkey % 7 + 1] AS strict, coalesce([true, false, true, false, NULL, NULL, true][o_custkey % 7 + 1], false) AS lenient, count(*) AS n FROM orders GROUP BY ALL",
    "prj28_event_kinds": oracle("SELECT event_type, CASE event_type WHEN 'fever' THEN 'disease' WHEN 'feed_failure' THEN 'management' ELSE 'other' END AS category, CASE WHEN event_type IN ('fever', 'feed_failure') THEN 'target' ELSE 'context' END AS role, CASE event_type WHEN 'fever' THEN 'disease_alert' WHEN 'feed_failure' THEN 'management_alert' ELSE 'any_alert' END AS target_alert, event_type IN ('fever', 'feed_failure') AS include_in_recall, count(*) AS n FROM farm_events GROUP BY ALL"),
    "join09_windows_before": oracle("WITH " + DAYS.strip() + " SELECT * EXCLUDE (event_type) FROM w"),
    "agg28_detection_recall": oracle("WITH " + DAYS.strip() + """,
t AS (SELECT *, CASE event_type WHEN 'fever' THEN 'disease' ELSE 'management' END AS category FROM w WHERE event_type IN ('fever', 'feed_failure'))
SELECT coalesce(category, 'all_targets') AS scope, count(*) AS events, """ + ", ".join(f"count_if({n}_detected) AS {n}_detected, round(avg({n}_detected::INT), 6) AS {n}_recall" for n in ("during", "pre_24h", "pre_48h", "pre_72h")) + " FROM t GROUP BY ROLLUP (category)"),
    "win17_robust_scores": oracle("""
WITH d AS (SELECT pig_id, day, sum(movement) AS moved FROM activity GROUP BY ALL), q AS (SELECT pig_id, quantile_cont(moved, 0.25) AS a, quantile_cont(moved, 0.5) AS m, quantile_cont(moved, 0.75) AS b FROM d GROUP BY 1)
SELECT pig_id, day, round(moved, 4) AS moved, round(greatest((m - moved) / (b - a + 1e-9), 0), 4) AS moved_drop_score FROM d JOIN q USING (pig_id)"""),
    "join08_clean_rows": oracle("SELECT event_id, chamber_id, start_datetime FROM farm_events e WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_discount * 20 >= 1.9 AND concat('c', l.l_suppkey % 50) = e.chamber_id AND e.start_datetime BETWEEN l.l_shipdate AND l.l_shipdate + INTERVAL 24 HOUR)"),
}
