"""Queries of the pen-day track: feeding, scores, policies, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from penlight.operators import alerts, evaluate, penday, quality, series
from penlight.sources.adapters import oracle, rounded, table

KEYS = ["experiment", "pen_id", "date"]
GROUPS = {"respiratory_signs": ["cough_sum"], "gut_signs": ["diarrhea_sum"], "heat_signs": ["panting_sum"]}
THRESHOLDS = {"feed_drop": -0.917, "co2_high": 3500.0, "nh3_high": 32.0, "barn_temp_high": 33.0, "humidity_high": 75.0}
CANDIDATE = THRESHOLDS | {"co2_high": 3200.0, "nh3_high": 30.0}
RATES = ["sensitivity", "specificity", "precision", "f1"]
POLICIES = {"screening": 28.7, "balanced": 30.4, "high_confidence": 31.6}
LEVELS = [0.3, 0.6, 0.9, 1.2]


def pen_days(spark, sf_dir):
    return penday.signs(table(spark, sf_dir, "pen_day"), GROUPS)


def scored(spark, sf_dir, thresholds=THRESHOLDS):
    return penday.rule_scores(pen_days(spark, sf_dir), thresholds)


def feeding_day(spark, sf_dir):
    return rounded(penday.feeding_day(table(spark, sf_dir, "visits")), "feed_intake", "mean_duration", "intake_per_pig")


def feeding_hour(spark, sf_dir):
    return rounded(penday.feeding_hour(table(spark, sf_dir, "visits")), "feed_intake")


def registered(spark, sf_dir):
    visits = table(spark, sf_dir, "visits")
    pens = penday.station_pens(visits.where("tattoo = 'FILLING'").select("experiment", "station", "pen_id"))
    return penday.with_pens(visits.select("experiment", "station", "intake"), pens).groupBy("experiment", "pen_id").agg(F.count("*").alias("visits"), F.max("registered_pigs").cast("double").alias("registered"))


def climate_day(spark, sf_dir):
    rows = table(spark, sf_dir, "visits").select(*KEYS, F.element_at(F.array(F.lit("CO2 ppm"), F.lit("Temperature C"), F.lit("Noise")), (F.col("station") % 3 + 1).cast("int")).alias("label"), F.col("duration").alias("value"))
    return rounded(penday.climate_day(rows, {"co2": "co2", "temperature": "temperature"}), *[f"{m}_{a}" for m in ("co2", "temperature") for a in ("mean", "max", "min")])


def health_day(spark, sf_dir):
    rows = table(spark, sf_dir, "visits").select(*KEYS, "pig", F.when(F.col("station") % 3 > 0, F.col("station") % 3).cast("double").alias("cough"), (F.col("pig") % 4).alias("lame"))
    return penday.health_day(rows, ["cough", "lame"])


def outer(spark, sf_dir):
    rows = table(spark, sf_dir, "pen_day")
    feed = rows.where("feed_intake > 30").select(*KEYS, "feed_intake")
    climate = rows.where("co2_max > 2000").select(*KEYS, "co2_max")
    health = rows.where("cough_sum > 0").select(*KEYS, F.col("cough_sum").cast("double").alias("cough_sum"))
    return penday.pen_days(feed, climate, health)


def availability(spark, sf_dir):
    rows = table(spark, sf_dir, "pen_day").withColumn("cough", F.when(F.col("cough_sum") > 0, F.col("cough_sum")))
    return penday.availability(rows, ["feed_intake", "cough"])


def labels(spark, sf_dir):
    rows = pen_days(spark, sf_dir).withColumn("health_rows", F.when(F.dayofmonth("date") > 1, F.col("health_rows")))
    return penday.labelled(rows).groupBy("pen_label").agg(F.count("*").alias("n"))


def observed(spark, sf_dir):
    rows = table(spark, sf_dir, "pen_day").withColumn("health_rows", F.when(F.dayofmonth("date") > 1, F.col("health_rows")))
    return penday.observed(rows).select(*KEYS)


def rule_scores(spark, sf_dir):
    names = ["management_score", "environment_score", "rule_score", "feed_env_score"]
    return rounded(scored(spark, sf_dir).select(*KEYS, *names, "rule_triggered_count", "rule_reasons"), *names)


SCORED = """
s AS (SELECT *, cough_sum > 0 AS respiratory_signs, diarrhea_sum > 0 AS gut_signs, panting_sum > 0 AS heat_signs, cough_sum > 0 OR diarrhea_sum > 0 OR panting_sum > 0 AS any_signs,
  feed_zscore <= -0.917 AS r1, co2_max >= {co2} AS r2, ammonia_max >= {nh3} AS r3, temperature_max >= 33 AS r4, humidity_max >= 75 AS r5 FROM pen_day),
{name} AS (SELECT *, (r2::INT + r3::INT + r4::INT + r5::INT) AS ke, r1::INT * 0.6::DOUBLE AS management_score, r2::INT * 0.3::DOUBLE + r3::INT * 0.3 + r4::INT * 0.6 + r5::INT * 0.3 + 0.3 * greatest(r2::INT + r3::INT + r4::INT + r5::INT - 1, 0) AS environment_score,
  round(r1::INT * 0.6::DOUBLE + r2::INT * 0.3 + r3::INT * 0.3 + r4::INT * 0.6 + r5::INT * 0.3 + 0.3 * greatest(r1::INT + r2::INT + r3::INT + r4::INT + r5::INT - 1, 0), 6) AS rule_score,
  concat_ws(',', CASE WHEN r1 THEN 'feed_drop' END, CASE WHEN r2 THEN 'co2_high' END, CASE WHEN r3 THEN 'nh3_high' END, CASE WHEN r4 THEN 'barn_temp_high' END, CASE WHEN r5 THEN 'humidity_high' END) AS rule_reasons FROM s)"""
BASE = SCORED.format(co2=3500, nh3=32, name="scored")


def policy(spark, sf_dir):
    """Scores a little off the level limits, where sums of tenths differ by rounding."""
    rows = scored(spark, sf_dir).withColumns({c: F.round(F.col(c) + 3e-9, 6) for c in ("rule_score", "environment_score")})
    return penday.alert_level(rows)


def alert_levels(spark, sf_dir):
    return policy(spark, sf_dir).select(*KEYS, "policy_rank", "policy_level", "temperature_policy")


LEVEL = BASE + """,
p AS (SELECT *, CASE WHEN rule_score >= 0.9 OR round(environment_score, 6) >= 0.9 THEN 1 WHEN rule_score >= 0.6 THEN 2 WHEN rule_score >= 0.3 THEN 3 ELSE 4 END AS policy_rank FROM scored),
l AS (SELECT *, ['cctv_focus', 'caution', 'observe', 'normal'][policy_rank] AS policy_level, CASE WHEN temperature_max >= 31.6 THEN 'high_confidence' WHEN temperature_max >= 30.4 THEN 'balanced' WHEN temperature_max >= 28.7 THEN 'screening' ELSE 'normal' END AS temperature_policy FROM p)"""


def level_summary(spark, sf_dir):
    return rounded(penday.level_summary(policy(spark, sf_dir), "any_signs"), "label_rate")


def pen_alerts(spark, sf_dir):
    rows = penday.as_alerts(policy(spark, sf_dir))
    return rounded(rows.select("source_dataset", "chamber_id", "start_datetime", "end_datetime", "track_score", "alert_category", "tier", "reason"), "track_score")


def pen_queue(spark, sf_dir):
    queue = alerts.action_queue(penday.as_alerts(policy(spark, sf_dir)))
    return queue.groupBy("queue", "priority").agg(F.count("*").alias("n"))


def frame(spark, sf_dir):
    return penday.recent_context(penday.precision_frame(scored(spark, sf_dir), scored(spark, sf_dir, CANDIDATE), limit=0.5999))


def precision_frame(spark, sf_dir):
    return rounded(penday.precision_frame(scored(spark, sf_dir), scored(spark, sf_dir, CANDIDATE), limit=0.5999), "candidate_score")


def recent_context(spark, sf_dir):
    return frame(spark, sf_dir).select(*KEYS, "recent_any", "recent_same_reason")


def precision_policies(spark, sf_dir):
    return rounded(penday.policy_metrics(frame(spark, sf_dir)), *RATES, "added_kept_match_rate", "added_dropped_match_rate")


def recommended(spark, sf_dir):
    return rounded(penday.recommended_policy(penday.policy_metrics(frame(spark, sf_dir))).select("policy", "n_alerts", *RATES), *RATES)


def added_reasons(spark, sf_dir):
    return rounded(penday.added_reasons(frame(spark, sf_dir)), "match_rate", "recent_same_reason_rate")


FRAME = "WITH " + SCORED.format(co2=3500, nh3=32, name="base").replace("s AS (", "s1 AS (", 1).replace("FROM s)", "FROM s1)").strip() + "," + SCORED.format(co2=3200, nh3=30, name="cand").replace("s AS (", "s2 AS (", 1).replace("FROM s)", "FROM s2)") + """,
f AS (SELECT experiment, pen_id, date, b.rule_score >= 0.5999 AS baseline_alert, c.rule_score >= 0.5999 AS candidate_alert, c.rule_score AS candidate_score, c.rule_reasons AS reasons, c.any_signs, c.rule_score >= 0.5999 AND NOT b.rule_score >= 0.5999 AS added_alert,
  (CASE WHEN c.rule_reasons = '' THEN 0 ELSE len(string_split(c.rule_reasons, ',')) END)::BIGINT AS reason_count, month(date) BETWEEN 1 AND 5 AS is_jan_to_may FROM base b JOIN cand c USING (experiment, pen_id, date))"""
CONTEXT = FRAME + """,
a AS (SELECT *, max(CASE WHEN candidate_alert THEN date END) OVER (PARTITION BY experiment, pen_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_any FROM f),
x AS (SELECT experiment, pen_id, date, candidate_alert, unnest(string_split(reasons, ',')) AS reason FROM f WHERE reasons <> ''),
y AS (SELECT experiment, pen_id, date, max(CASE WHEN candidate_alert THEN date END) OVER (PARTITION BY experiment, pen_id, reason ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_same FROM x),
z AS (SELECT experiment, pen_id, date, bool_or(coalesce(date - last_same <= 14, false)) AS same FROM y GROUP BY ALL),
r AS (SELECT a.* EXCLUDE (last_any), coalesce(a.date - last_any <= 14, false) AS recent_any, coalesce(same, false) AS recent_same_reason FROM a LEFT JOIN z USING (experiment, pen_id, date))"""
MASKS = {
    "baseline_only": "baseline_alert",
    "recall_candidate_all": "candidate_alert",
    "added_score_0_6": "baseline_alert OR (added_alert AND candidate_score >= 0.6)",
    "added_env_cooccurrence": "baseline_alert OR (added_alert AND reason_count >= 2)",
    "added_high_match_reasons": "baseline_alert OR (added_alert AND reasons IN ('co2_high,nh3_high,humidity_high', 'nh3_high', 'co2_high'))",
    "added_nh3_or_triple_env": "baseline_alert OR (added_alert AND reasons IN ('co2_high,nh3_high,humidity_high', 'nh3_high,humidity_high', 'nh3_high'))",
    "added_recent_any_14d": "baseline_alert OR (added_alert AND recent_any)",
    "added_recent_same_reason_14d": "baseline_alert OR (added_alert AND recent_same_reason)",
    "added_cooccurrence_or_recent_same_reason": "baseline_alert OR (added_alert AND (reason_count >= 2 OR recent_same_reason))",
}
COUNTS = "count(*) AS n, count_if(on_) AS n_alerts, count_if(on_ AND any_signs) AS tp, count_if(NOT on_ AND any_signs) AS fn, count_if(on_ AND NOT any_signs) AS fp, count_if(NOT on_ AND NOT any_signs) AS tn"


def rates(source: str) -> str:
    """sensitivity, specificity, precision and f1 in SQL."""
    s, p = "tp / nullif(tp + fn, 0)::DOUBLE", "tp / nullif(tp + fp, 0)::DOUBLE"
    return f"SELECT *, round({s}, 6) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity, round({p}, 6) AS precision, round(CASE WHEN tp > 0 THEN 2 * ({s}) * ({p}) / (({s}) + ({p})) END, 6) AS f1 FROM ({source})"


POLICY_ROWS = CONTEXT + ", m AS (" + " UNION ALL ".join(f"SELECT '{n}' AS policy, *, {c} AS on_ FROM r" for n, c in MASKS.items()) + "), e AS (SELECT 'all' AS scope, * FROM m UNION ALL SELECT 'jan_may', * FROM m WHERE is_jan_to_may)"
POLICY_METRICS = POLICY_ROWS + " " + rates(f"SELECT policy, scope, {COUNTS}, count_if(added_alert AND on_) AS added_kept, count_if(added_alert AND NOT on_) AS added_dropped, round(count_if(added_alert AND on_ AND any_signs) / nullif(count_if(added_alert AND on_), 0)::DOUBLE, 6) AS added_kept_match_rate, round(count_if(added_alert AND NOT on_ AND any_signs) / nullif(count_if(added_alert AND NOT on_), 0)::DOUBLE, 6) AS added_dropped_match_rate FROM e GROUP BY ALL")


def confusion(spark, sf_dir):
    rows = pen_days(spark, sf_dir)
    found = [evaluate.confusion(rows, c, t, s, above).withColumn("name", F.lit(c)) for c, t, s, above in (("temperature_max", 31.6, "heat_signs", True), ("feed_zscore", -0.917, "any_signs", False))]
    return rounded(found[0].unionByName(found[1]), *RATES)


def composite(spark, sf_dir):
    rows = pen_days(spark, sf_dir)
    hits = {"feed": F.col("feed_zscore") <= -0.917, "co2": F.col("co2_max") >= 3500, "nh3": F.col("ammonia_max") >= 32}
    rules = hits | {"feed_co2": hits["feed"] & hits["co2"], "feed_nh3": hits["feed"] & hits["nh3"], "co2_nh3": hits["co2"] & hits["nh3"], "all": hits["feed"] & hits["co2"] & hits["nh3"]}
    return rounded(evaluate.rule_confusion(rows, rules, "any_signs"), *RATES)


def swept(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumns({c: F.round(F.col(c) + 3e-9, 6) for c in ("rule_score", "environment_score")})
    return evaluate.sweep(rows, [("rule_score", "any_signs"), ("environment_score", "heat_signs")], LEVELS)


def sweep(spark, sf_dir):
    return rounded(swept(spark, sf_dir), *RATES)


def best_thresholds(spark, sf_dir):
    return rounded(evaluate.best_rows(swept(spark, sf_dir)), "f1", "precision", "sensitivity")


SWEEP = "WITH " + BASE.strip() + """,
v AS (SELECT 'rule_score' AS score, 'any_signs' AS sign, rule_score AS value, any_signs FROM scored UNION ALL SELECT 'environment_score', 'heat_signs', round(environment_score, 6), heat_signs FROM scored),
h AS (SELECT score, sign, threshold, value >= threshold AS on_, any_signs FROM v, (SELECT unnest([0.3, 0.6, 0.9, 1.2])::DOUBLE AS threshold)),
g AS (SELECT score, sign, threshold, """ + COUNTS + " FROM h GROUP BY ALL), t AS (" + rates("SELECT * FROM g") + ")"
TEMPERATURES = [27.0, 29.0, 31.0, 33.0, 34.5]


def temperature_sweep(spark, sf_dir):
    return evaluate.sweep(pen_days(spark, sf_dir), [("temperature_max", "heat_signs")], TEMPERATURES)


def threshold_choices(spark, sf_dir):
    return evaluate.threshold_choices(temperature_sweep(spark, sf_dir))


TEMPERATURE_SWEEP = "WITH h AS (SELECT threshold, 15 + max(l_quantity) / 2.5 >= threshold AS on_, count_if(l_quantity > 48) > 0 AS any_signs FROM lineitem, (SELECT unnest([27.0, 29.0, 31.0, 33.0, 34.5])::DOUBLE AS threshold) GROUP BY threshold, l_linenumber % 2, l_suppkey % 5, l_shipdate::DATE), g AS (SELECT threshold, " + COUNTS + " FROM h GROUP BY 1), t AS (" + rates("SELECT * FROM g") + ")"


def percentile_sweep(spark, sf_dir):
    rows = pen_days(spark, sf_dir)
    return rounded(evaluate.percentile_sweep(rows, "co2_max", "respiratory_signs", [0.1, 0.5, 0.9, 0.99], 2984.0), "threshold", *RATES)


def burden(spark, sf_dir):
    return rounded(evaluate.alert_burden(pen_days(spark, sf_dir), "temperature_max", "heat_signs", POLICIES), *RATES, "alerts_per_day", "false_alerts_per_day", "alerts_per_100")


def top_pen_days(spark, sf_dir):
    """A report of the twenty highest scores."""
    rows = scored(spark, sf_dir).select(*KEYS, F.round(F.col("rule_score") + 3e-9, 6).alias("rule_score"), "rule_reasons")
    return rows.orderBy(F.desc("rule_score"), "experiment", "pen_id", "date").limit(20)


def rolling_intake(spark, sf_dir):
    rows = series.rolling_rows(table(spark, sf_dir, "pen_day"), "feed_intake", ["experiment", "pen_id"], "date")
    return rounded(rows.select(*KEYS, "feed_intake_3d_mean", "feed_intake_drop_pct_1d", "feed_intake_drop_pct_3d"), "feed_intake_3d_mean", "feed_intake_drop_pct_1d", "feed_intake_drop_pct_3d")


def hourly_worst(spark, sf_dir):
    hours = rounded(penday.feeding_hour(table(spark, sf_dir, "visits")), "feed_intake")
    rolled = series.rolling_features(hours, ["feed_intake"], ["experiment", "pen_id"])
    return rounded(penday.hourly_worst(rolled, "feed_intake"), "feed_intake_min_zscore_3d", places=5)


def shift(spark, sf_dir):
    return rounded(evaluate.group_shift(pen_days(spark, sf_dir), ["co2_max", "feed_intake"], F.col("any_signs")), "inside", "outside", "difference", "relative_change", places=5)


def distribution(spark, sf_dir):
    return rounded(evaluate.distribution(table(spark, sf_dir, "pen_day"), ["co2_max", "feed_intake"], ["experiment"]), "mean", "std", "min", "p25", "median", "p75", "max", places=4)


def text_forms(spark, sf_dir):
    n = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        n, quality.normal_key(F.concat_ws("", F.lit("pen"), n.cast("string"), F.lit(".0"))).alias("key"),
        quality.mixed_date(F.element_at(F.array(F.date_format("l_shipdate", "yyyyMMdd"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.date_format("l_shipdate", "d/M/yyyy"), F.lit("?")), (n % 4 + 1).cast("int"))).alias("date"),
        quality.pen_label(F.concat(F.lit("A"), (n % 20).cast("string")), n % 3).alias("pen"), quality.station_number(F.concat(F.lit("F"), n.cast("string"))).alias("station"), quality.leading_number(F.concat((n % 7).cast("string"), F.lit("(GREASY)"))).alias("number"),
    )
    return rows.groupBy("date", "pen", "number").agg(F.count("*").alias("n"), F.max("key").alias("key"), F.max("station").alias("station"))


def compatibility(spark, sf_dir):
    return evaluate.compatibility(table(spark, sf_dir, "pen_day"), table(spark, sf_dir, "visits"), {"feed_intake": "intake", "humidity_max": "duration", "absent": "pig"})


def compared(spark, sf_dir):
    names = ["left_mean", "left_std", "left_p50", "left_p90", "right_mean", "right_std", "right_p50", "right_p90", "mean_ratio"]
    return rounded(compatibility(spark, sf_dir), *names, places=5)


def decision(spark, sf_dir):
    return evaluate.compatibility_decision(compatibility(spark, sf_dir), 3, 2)


QUERIES = {
    "agg11_feeding_day": feeding_day, "agg12_feeding_hour": feeding_hour, "join10_station_pens": registered, "agg13_climate_day": climate_day, "agg14_health_day": health_day, "join03_pen_days": outer, "agg15_availability": availability,
    "prj18_pen_labels": labels, "prj16_observed": observed, "dom07_rule_scores": rule_scores, "dom09_alert_levels": alert_levels, "agg32_level_summary": level_summary, "dom12_pen_alerts": pen_alerts, "dom12_pen_queue": pen_queue,
    "join11_precision_frame": precision_frame, "win14_recent_context": recent_context, "evl06_precision_policies": precision_policies, "top08_recommended_policy": recommended, "evl06_added_reasons": added_reasons,
    "evl01_confusion": confusion, "evl04_composite_rules": composite, "evl05_score_sweep": sweep, "top04_best_thresholds": best_thresholds, "top07_threshold_choices": threshold_choices, "evl03_percentile_sweep": percentile_sweep, "evl07_alert_burden": burden,
    "agg41_top_pen_days": top_pen_days, "win09_rolling_intake": rolling_intake, "win21_hourly_worst": hourly_worst, "agg31_group_shift": shift, "agg23_distribution": distribution, "prj12_text_forms": text_forms, "agg34_compatibility": compared, "agg34_decision": decision,
}
BURDEN = "WITH " + BASE.strip() + ", h AS (SELECT p.policy, p.threshold, date, temperature_max >= p.threshold AS on_, heat_signs AS any_signs FROM scored, (VALUES ('screening', 28.7::DOUBLE), ('balanced', 30.4), ('high_confidence', 31.6)) p(policy, threshold)), g AS (" + rates(f"SELECT policy, threshold, {COUNTS}, count(DISTINCT date) AS days, count(DISTINCT CASE WHEN on_ THEN date END) AS alert_days FROM h GROUP BY ALL") + ") SELECT *, round(n_alerts / days::DOUBLE, 6) AS alerts_per_day, round(fp / days::DOUBLE, 6) AS false_alerts_per_day, round(100 * n_alerts / n::DOUBLE, 6) AS alerts_per_100 FROM g"
VALID = "tattoo = 'ok' AND intake > 0"
COMPAT = """
WITH l AS (SELECT 'feed_intake' AS feature, 'intake' AS right_feature, feed_intake AS v FROM pen_day UNION ALL SELECT 'humidity_max', 'duration', humidity_max FROM pen_day), r AS (SELECT 'intake' AS right_feature, intake AS v FROM visits UNION ALL SELECT 'duration', duration FROM visits),
a AS (SELECT feature, right_feature, count(*) AS left_n, avg(v) AS lm, stddev_pop(v) AS ls, quantile_cont(v, 0.5) AS l5, quantile_cont(v, 0.9) AS l9 FROM l GROUP BY ALL), b AS (SELECT right_feature, count(*) AS right_n, avg(v) AS rm, stddev_pop(v) AS rs, quantile_cont(v, 0.5) AS r5, quantile_cont(v, 0.9) AS r9 FROM r GROUP BY ALL)"""
ORACLE_SQL = {
    "agg11_feeding_day": oracle(f"SELECT experiment, pen_id, date, count(*) AS records, count_if({VALID}) AS valid_visits, count_if(tattoo = 'GHOST') AS ghost_visits, count_if(tattoo = 'FILLING') AS filling_visits, round(sum(CASE WHEN {VALID} THEN intake END), 6) AS feed_intake, round(avg(CASE WHEN {VALID} THEN duration END), 6) AS mean_duration, count(DISTINCT CASE WHEN {VALID} THEN pig END) AS active_pigs, count(DISTINCT station) AS stations, round(sum(CASE WHEN {VALID} THEN intake END) / nullif(count(DISTINCT CASE WHEN {VALID} THEN pig END), 0), 6) AS intake_per_pig FROM visits GROUP BY ALL"),
    "agg12_feeding_hour": oracle("SELECT experiment, pen_id, date_trunc('hour', visited_at) AS datetime, round(sum(intake), 6) AS feed_intake, count(*) AS visits FROM visits GROUP BY ALL"),
    "join10_station_pens": oracle("WITH p AS (SELECT experiment, station, pen_id, count(*) AS registered_pigs FROM visits WHERE tattoo = 'FILLING' GROUP BY ALL) SELECT v.experiment, p.pen_id, count(*) AS visits, max(registered_pigs)::DOUBLE AS registered FROM visits v LEFT JOIN p USING (experiment, station) GROUP BY ALL"),
    "agg13_climate_day": oracle("SELECT experiment, pen_id, date, " + ", ".join(f"round({f}(CASE WHEN station % 3 = {k} THEN duration END), 6) AS {m}_{a}" for m, k in (("co2", 0), ("temperature", 1)) for a, f in (("mean", "avg"), ("max", "max"), ("min", "min"))) + " FROM visits WHERE station % 3 < 2 GROUP BY ALL"),
    "agg14_health_day": oracle("SELECT experiment, pen_id, date, count(*) AS health_rows, count(DISTINCT pig) AS health_pigs, sum(CASE WHEN station % 3 > 0 THEN station % 3 END)::DOUBLE AS cough_sum, max(CASE WHEN station % 3 > 0 THEN station % 3 END)::DOUBLE AS cough_max, sum(pig % 4)::BIGINT AS lame_sum, max(pig % 4) AS lame_max FROM visits GROUP BY ALL"),
    "join03_pen_days": oracle("SELECT experiment, pen_id, date, CASE WHEN feed_intake > 30 THEN feed_intake END AS feed_intake, CASE WHEN co2_max > 2000 THEN co2_max END AS co2_max, (CASE WHEN cough_sum > 0 THEN cough_sum END)::DOUBLE AS cough_sum FROM pen_day WHERE feed_intake > 30 OR co2_max > 2000 OR cough_sum > 0"),
    "agg15_availability": oracle("SELECT year(date) AS year, month(date) AS month, count(*) AS rows, count(DISTINCT (experiment, pen_id)) AS pens, min(date) AS first_date, max(date) AS last_date, count(feed_intake) AS feed_intake_days, count_if(cough_sum > 0) AS cough_days FROM pen_day GROUP BY ALL"),
    "prj18_pen_labels": oracle("SELECT CASE WHEN day(date) = 1 THEN 'unobserved' WHEN cough_sum > 0 OR diarrhea_sum > 0 OR panting_sum > 0 THEN 'symptomatic' ELSE 'normal' END AS pen_label, count(*) AS n FROM pen_day GROUP BY ALL"),
    "prj16_observed": oracle("SELECT experiment, pen_id, date FROM pen_day WHERE day(date) > 1"),
    "dom07_rule_scores": oracle("WITH " + BASE.strip() + " SELECT experiment, pen_id, date, round(management_score, 6) AS management_score, round(environment_score, 6) AS environment_score, rule_score, round(management_score + environment_score, 6) AS feed_env_score, (r1::INT + ke)::BIGINT AS rule_triggered_count, rule_reasons FROM scored"),
    "dom09_alert_levels": oracle("WITH " + LEVEL.strip() + " SELECT experiment, pen_id, date, policy_rank::BIGINT AS policy_rank, policy_level, temperature_policy FROM l"),
    "agg32_level_summary": oracle("WITH " + LEVEL.strip() + ", k AS (SELECT unnest(range(1, 5)) AS policy_rank), n AS (SELECT policy_rank, count(*) AS n, count_if(any_signs) AS y FROM l GROUP BY 1) SELECT k.policy_rank, ['cctv_focus', 'caution', 'observe', 'normal'][k.policy_rank] AS policy_level, coalesce(n, 0) AS pen_days, coalesce(y, 0) AS labelled, round(y / n::DOUBLE, 6) AS label_rate FROM k LEFT JOIN n USING (policy_rank)"),
    "dom12_pen_alerts": oracle("WITH " + LEVEL.strip() + " SELECT experiment::VARCHAR AS source_dataset, concat('pen:', experiment, ':', pen_id) AS chamber_id, date::TIMESTAMP AS start_datetime, date::TIMESTAMP + INTERVAL 86399 SECOND AS end_datetime, rule_score AS track_score, concat_ws(',', CASE WHEN r1 THEN 'management' END, CASE WHEN ke > 0 THEN 'environment' END) AS alert_category, CASE policy_rank WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'normal' END AS tier, concat(policy_level, ': ', rule_reasons) AS reason FROM l WHERE policy_rank < 4"),
    "dom12_pen_queue": oracle("WITH " + LEVEL.strip() + ", q AS (SELECT 'management' AS queue, 'watch' AS priority FROM l WHERE policy_rank < 4 AND r1 UNION ALL SELECT 'environment', CASE WHEN round(environment_score, 6) >= 1.2 THEN 'urgent' ELSE 'high' END FROM l WHERE policy_rank < 4 AND ke > 0) SELECT queue, priority, count(*) AS n FROM q GROUP BY ALL"),
    "join11_precision_frame": oracle(FRAME + " SELECT * FROM f"),
    "win14_recent_context": oracle(CONTEXT + " SELECT experiment, pen_id, date, recent_any, recent_same_reason FROM r"),
    "evl06_precision_policies": oracle(POLICY_METRICS),
    "top08_recommended_policy": oracle(POLICY_ROWS + ", t AS (" + rates(f"SELECT policy, {COUNTS} FROM m GROUP BY ALL") + "), b AS (SELECT * FROM t WHERE policy = 'baseline_only') SELECT t.policy, t.n_alerts, t.sensitivity, t.specificity, t.precision, t.f1 FROM t, b WHERE t.policy = 'baseline_only' OR (t.policy <> 'recall_candidate_all' AND t.sensitivity >= b.sensitivity) ORDER BY t.policy <> 'baseline_only' DESC, t.f1 DESC, t.precision DESC, t.sensitivity DESC, t.n_alerts, t.policy LIMIT 1"),
    "evl06_added_reasons": oracle(CONTEXT + " SELECT reasons, count(*) AS added_alerts, count_if(any_signs) AS matched, count_if(recent_any) AS recent_any, count_if(recent_same_reason) AS recent_same_reason, round(count_if(any_signs) / count(*)::DOUBLE, 6) AS match_rate, round(count_if(recent_same_reason) / count(*)::DOUBLE, 6) AS recent_same_reason_rate FROM r WHERE added_alert GROUP BY 1"),
    "evl01_confusion": oracle("WITH " + BASE.strip() + ", h AS (SELECT 'temperature_max' AS name, temperature_max >= 31.6 AS on_, heat_signs AS any_signs FROM scored UNION ALL SELECT 'feed_zscore', feed_zscore <= -0.917, any_signs FROM scored) " + rates(f"SELECT name, {COUNTS} FROM h GROUP BY 1")),
    "evl04_composite_rules": oracle("WITH " + BASE.strip() + ", h AS (SELECT any_signs, unnest([{'r': 'feed', 'o': r1}, {'r': 'co2', 'o': r2}, {'r': 'nh3', 'o': r3}, {'r': 'feed_co2', 'o': r1 AND r2}, {'r': 'feed_nh3', 'o': r1 AND r3}, {'r': 'co2_nh3', 'o': r2 AND r3}, {'r': 'all', 'o': r1 AND r2 AND r3}]) AS x FROM scored), y AS (SELECT any_signs, x.r AS rule, x.o AS on_ FROM h) " + rates(f"SELECT rule, {COUNTS} FROM y GROUP BY 1")),
    "evl05_score_sweep": oracle(SWEEP + " SELECT * FROM t"),
    "top04_best_thresholds": oracle(SWEEP + " SELECT score, sign, threshold, n, n_alerts, f1, precision, sensitivity FROM t WHERE f1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY score, sign ORDER BY f1 DESC, precision DESC, sensitivity DESC, threshold) = 1"),
    "top07_threshold_choices": oracle(TEMPERATURE_SWEEP + ", b AS (SELECT (SELECT threshold FROM t ORDER BY f1 DESC NULLS LAST, precision DESC NULLS LAST, threshold LIMIT 1) AS balanced, (SELECT threshold FROM t WHERE sensitivity >= 0.9 ORDER BY f1 DESC NULLS LAST, precision DESC NULLS LAST, threshold LIMIT 1) AS s, (SELECT threshold FROM t WHERE precision >= 0.45 AND specificity >= 0.95 ORDER BY f1 DESC NULLS LAST, precision DESC NULLS LAST, threshold LIMIT 1) AS p) SELECT 'balanced' AS policy, balanced AS threshold FROM b UNION ALL SELECT 'screening', coalesce(s, balanced) FROM b UNION ALL SELECT 'high_confidence', coalesce(p, balanced) FROM b"),
    "evl03_percentile_sweep": oracle("WITH " + BASE.strip() + ", c AS (SELECT DISTINCT unnest(list_append(quantile_cont(co2_max, [0.1, 0.5, 0.9, 0.99]), 2984.0)) AS cut FROM scored), h AS (SELECT cut, co2_max >= cut AS on_, respiratory_signs AS any_signs FROM scored, c) " + rates(f"SELECT round(cut, 6) AS threshold, {COUNTS} FROM h GROUP BY cut")),
    "evl07_alert_burden": oracle(BURDEN),
    "agg41_top_pen_days": oracle("WITH " + BASE.strip() + " SELECT experiment, pen_id, date, rule_score, rule_reasons FROM scored ORDER BY rule_score DESC, experiment, pen_id, date LIMIT 20"),
    "win09_rolling_intake": oracle("SELECT experiment, pen_id, date, round(avg(feed_intake) OVER (PARTITION BY experiment, pen_id ORDER BY date ROWS 2 PRECEDING), 6) AS feed_intake_3d_mean, round(-100 * (feed_intake / nullif(lag(feed_intake) OVER o, 0) - 1), 6) AS feed_intake_drop_pct_1d, round(-100 * (feed_intake / nullif(lag(feed_intake, 3) OVER o, 0) - 1), 6) AS feed_intake_drop_pct_3d FROM pen_day WINDOW o AS (PARTITION BY experiment, pen_id ORDER BY date)"),
    "win21_hourly_worst": oracle("""
WITH h AS (SELECT experiment, pen_id, date_trunc('hour', visited_at) AS t, round(sum(intake), 6) AS v FROM visits GROUP BY ALL),
z AS (SELECT *, coalesce((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 0) AS z FROM h WINDOW w AS (PARTITION BY experiment, pen_id ORDER BY t RANGE BETWEEN INTERVAL '71 hours 59 minutes' PRECEDING AND CURRENT ROW))
SELECT experiment, pen_id, t::DATE AS date, round(min(z), 5) AS feed_intake_min_zscore_3d FROM z GROUP BY ALL"""),
    "agg31_group_shift": oracle("WITH " + BASE.strip() + ", v AS (SELECT any_signs, unnest([{'f': 'co2_max', 'v': co2_max}, {'f': 'feed_intake', 'v': feed_intake}]) AS x FROM scored), m AS (SELECT x.f AS feature, avg(CASE WHEN any_signs THEN x.v END) AS a, avg(CASE WHEN NOT any_signs THEN x.v END) AS b FROM v GROUP BY 1) SELECT feature, round(a, 5) AS inside, round(b, 5) AS outside, round(a - b, 5) AS difference, round((a - b) / b, 5) AS relative_change FROM m"),
    "agg23_distribution": oracle("WITH v AS (SELECT experiment, unnest([{'f': 'co2_max', 'v': co2_max}, {'f': 'feed_intake', 'v': feed_intake}]) AS x FROM pen_day) SELECT experiment, x.f AS feature, count(*) AS n, round(avg(x.v), 4) AS mean, round(stddev_samp(x.v), 4) AS std, round(min(x.v), 4) AS min, round(quantile_cont(x.v, 0.25), 4) AS p25, round(quantile_cont(x.v, 0.5), 4) AS median, round(quantile_cont(x.v, 0.75), 4) AS p75, round(max(x.v), 4) AS max FROM v GROUP BY ALL"),
    "prj12_text_forms": "SELECT CASE WHEN l_orderkey % 4 < 3 THEN l_shipdate::DATE END AS date, CASE WHEN l_orderkey % 20 < 10 THEN concat('A', l_orderkey % 20, '.', l_orderkey % 3) ELSE concat('A', l_orderkey % 20) END AS pen, (l_orderkey % 7)::DOUBLE AS number, count(*) AS n, max(CASE WHEN l_orderkey >= 100 THEN l_orderkey::VARCHAR ELSE concat('pen', l_orderkey) END) AS key, max(l_orderkey) AS station FROM lineitem GROUP BY 1, 2, 3",
    "agg34_compatibility": oracle(COMPAT + " SELECT right_feature, feature, left_n, right_n, round(lm, 5) AS left_mean, round(ls, 5) AS left_std, round(l5, 5) AS left_p50, round(l9, 5) AS left_p90, round(rm, 5) AS right_mean, round(rs, 5) AS right_std, round(r5, 5) AS right_p50, round(r9, 5) AS right_p90, round(rm / lm, 5) AS mean_ratio FROM a JOIN b USING (right_feature)"),
    "agg34_decision": oracle(COMPAT + " SELECT count(*) AS shared_features, CASE WHEN count(*) >= 3 THEN 'compatible' WHEN count(*) >= 2 THEN 'partly_compatible' ELSE 'not_compatible' END AS decision FROM a JOIN b USING (right_feature)"),
}
