"""Queries of comparisons, rollups over several tables and input forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from penlight.operators import alerts, compare, composite, evaluate, quality, rules, series, vision
from penlight.plans import pens, sensor, tracks
from penlight.sources.adapters import oracle, rounded, table

CANDIDATE = [r | {"threshold": 41.5} if r["id"] == "rectal_temp_high" else r for r in sensor.RULES if r["id"] != "water_spike"]


def rule_sets(spark, sf_dir):
    rows = compare.rule_set_rows(sensor.raw_windows(spark, sf_dir), {"baseline": sensor.RULES, "candidate": CANDIDATE}, sensor.WINDOW)
    return rounded(compare.rule_sets_compared(rows), "mean_score", "max_score")


def upgrade(spark, sf_dir):
    rows = table(spark, sf_dir, "alerts")
    both = rows.where("final_alert").select(F.lit("baseline").alias("rule_set"), "chamber_id", "start_datetime").unionByName(rows.where("operational_alert").select(F.lit("candidate").alias("rule_set"), "chamber_id", "start_datetime"))
    return rounded(compare.lead_by_set(table(spark, sf_dir, "farm_events"), both), "mean_first_lead_hours", "recall_24h", "recall_48h", "recall_72h")


def overridden(spark, sf_dir):
    found = rules.evaluate(sensor.raw_windows(spark, sf_dir), rules.override(sensor.RULES, rules.parsed_overrides("co2_high=1100")), sensor.WINDOW)
    return found.groupBy("rule_reasons").agg(F.count("*").alias("n"))


def raw_values(spark, sf_dir):
    hourly = sensor.hourly(spark, sf_dir)
    val = series.split_by_ratio(hourly, sensor.KEYS, 0.8).where("split = 'val'")
    return rounded(compare.raw_values(val, hourly, [*sensor.KEYS, "datetime"], ["watersupply_mean"]), "watersupply_mean")


def timeline(spark, sf_dir):
    rows, key = table(spark, sf_dir, "challenge"), ["pig_id", "day"]
    parts = [rows.where("day % 2 = 0").select(*key, "rectal_temperature"), rows.where("pig_id % 3 > 0").select(*key, F.col("clinical").cast("double").alias("clinical")), rows.where("pig_id % 5 > 1").select(*key, (F.col("rectal_temperature") * 2 - 70).alias("active")), rows.where("day > 4").select(*key, F.col("viral").cast("double").alias("viral"))]
    return rounded(compare.daily_timeline(parts, rows.where("pig_id % 7 = 0 and day > 9")), "rectal_temperature", "active")


def flagged(spark, sf_dir):
    rows = table(spark, sf_dir, "scored_windows")
    flags = rows.groupBy("pig").agg((F.count("*") < 20).alias("low_confidence")).where("low_confidence")
    return rounded(compare.with_quality_flags(rows, flags, ["pig"]), "error", places=5)


def hours_of(spark, sf_dir):
    return vision.animal_hours(table(spark, sf_dir, "activity"))


def rollup(spark, sf_dir):
    return rounded(compare.animal_rollup(hours_of(spark, sf_dir)), "total", "mean", "largest", places=4)


def coverage(spark, sf_dir):
    return rounded(compare.pig_days(hours_of(spark, sf_dir)), "coverage")


def drops(spark, sf_dir):
    """A report of the five largest falls."""
    return rounded(compare.largest_drops(vision.animal_days(hours_of(spark, sf_dir)).select("pig_id", "day", "total")), "total", "total_change", places=4)


def detected(spark, sf_dir):
    rows = tracks.scored_windows(spark, sf_dir).withColumn("elapsed_day", F.floor(F.col("seq") / 100) + 1)
    return evaluate.detected(rows, F.col("split") == "val", 90.0, ["split", "pig"], ["seq"], 2)


def by_animal(spark, sf_dir):
    return rounded(evaluate.detection_summary(detected(spark, sf_dir), ["split", "pig"]), "mean_error", "raw_rate", "confirmed_rate", places=5)


def by_day(spark, sf_dir):
    return rounded(evaluate.detection_summary(detected(spark, sf_dir), ["split", "elapsed_day"]), "mean_error", "raw_rate", "confirmed_rate", places=5)


def temperatures(spark, sf_dir):
    rows = sensor.hourly(spark, sf_dir)
    return rounded(compare.named_series(rows, [*sensor.KEYS, "datetime"], {"barn": "barn_temperature_mean", "rectal": "rectal_temperature_mean"}), "value")


BURDEN = ["n_alerts", "sensitivity", "precision", "f1", "false_alerts_per_day"]
SCORES = ["n_alerts", "sensitivity", "specificity", "precision"]


def performance(spark, sf_dir):
    policies = evaluate.alert_burden(pens.pen_days(spark, sf_dir), "temperature_max", "heat_signs", pens.POLICIES)
    scores = pens.swept(spark, sf_dir).withColumn("name", F.concat_ws(" ", "score", F.col("threshold").cast("string")))
    return rounded(compare.performance_rows({"policy": (policies, "policy", BURDEN), "score": (scores, "name", SCORES)}), "value")


def coerced(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 0, "NaN").when(n == 1, F.col("l_quantity").cast("string")).otherwise("n/a").alias("quantity"))
    return quality.coerced(rows, ["quantity", "absent"])


def time_index(spark, sf_dir):
    n = F.col("o_orderkey") % 4
    day = F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(n == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(n == 1, "?").alias("timestamp"), F.when(n < 3, F.date_format(day, "yyMMdd")).alias("date"), F.lit("0930").alias("time"))
    return quality.time_index(rows).select("o_orderkey", "datetime")


def ready(spark, sf_dir):
    rows = table(spark, sf_dir, "points").withColumn("annotation_type", F.when(F.col("point_count") % 2 == 0, "points").otherwise("box"))
    return composite.model_ready(rows, ["facility", "pen", "center_x", "absent"]).groupBy("facility", "pen").agg(F.count("*").alias("n"), F.max("center_x").alias("center_x"))


def model_track(spark, sf_dir):
    rows = table(spark, sf_dir, "alerts").withColumns({"reconstruction_error": F.col("track_score"), "confirmed_anomaly": F.col("model_anomaly")})
    found = alerts.activity_track(rows, 0.25)
    return rounded(found.groupBy("chamber_id", "tier", "alert_category").agg(F.count("*").alias("n"), F.max("track_score").alias("top"), F.count_if("low_confidence").alias("low")), "top")


def wearable(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("PigID"), F.when(F.col("user_id") % 5 > 0, F.col("ts").cast("string")).otherwise("-").alias("Time"), F.col("value").alias("HR_raw"), F.lit(1).alias("spare"))
    return compare.renamed(rows, {"PigID": "pig_id", "Time": "datetime", "HR_raw": "heart_rate", "Skin": "skin"}, "datetime").groupBy("pig_id").agg(F.count("*").alias("n"), F.count("datetime").alias("timed"), F.max("datetime").alias("last"), F.max("heart_rate").alias("heart_rate"))


def clips(spark, sf_dir):
    n = F.col("o_orderkey")
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_ch"), (n % 5).cast("string"), F.when(n % 3 > 0, F.concat(F.lit("_facility"), (n % 4).cast("string"))).otherwise(""), F.lit("_pen0"), (n % 7).cast("string"), F.when(n % 2 == 0, F.concat(F.lit("_Chamber"), (n % 6).cast("string"))).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(k) for k, c in quality.clip_parts(name).items()])


def usable(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.when(F.col("l_linenumber") > 3, F.col("l_tax")).alias("l_tax"), F.lit(None).cast("double").alias("spare"))
    names = quality.usable_features(rows, ["l_orderkey", "l_linenumber"], exclude=["l_discount"])
    return rows.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "rows")


QUERIES = {
    "prj03_clip_parts": clips, "prj11_usable_features": usable,
    "dom15_rule_sets": rule_sets, "dom15_upgrade_lead": upgrade, "dom13_overrides": overridden, "join02_raw_values": raw_values, "join05_daily_timeline": timeline, "join15_quality_flags": flagged,
    "agg17_animal_rollup": rollup, "agg17_pig_days": coverage, "agg17_largest_drops": drops, "agg39_by_animal": by_animal, "agg39_by_day": by_day, "agg40_temperature_series": temperatures, "dom19_performance_rows": performance,
    "prj02_coerced": coerced, "prj01_time_index": time_index, "prj05_model_ready": ready, "dom04_activity_track": model_track, "src13_wearable": wearable,
}

SETS = "base AS (SELECT coalesce(b_max >= 40.0, false) AS h2, coalesce(f_mean <= -0.1, false) AS h3, coalesce(w_mean >= 0.1, false) AS h4, coalesce(w_mean <= -0.1, false) AS h5, coalesce(c_max >= 1000.0, false) AS h6, coalesce(b_max >= 35.0, false) AND coalesce(c_max >= 950.0, false) AS h7, t_max FROM full_windows), v AS (SELECT 'baseline' AS rule_set, h2, h3, h4, h5, h6, h7, coalesce(t_max >= 41.0, false) AS h1 FROM base UNION ALL SELECT 'candidate', h2, h3, false, h5, h6, h7, coalesce(t_max >= 41.5, false) FROM base)"
HITS = "s AS (SELECT rule_set, h1::INT + h2::INT + h3::INT + h4::INT + h5::INT + h6::INT + h7::INT AS k, h1::INT * 1.0::DOUBLE AS d, round(h3::INT * 0.6 + h4::INT * 0.3 + h5::INT * 0.6 + 0.3 * greatest(h3::INT + h4::INT + h5::INT - 1, 0), 6) AS m, round(h2::INT * 0.6 + h6::INT * 0.3 + h7::INT * 0.6 + 0.3 * greatest(h2::INT + h6::INT + h7::INT - 1, 0), 6) AS e, h1::INT * 1.0::DOUBLE + h3::INT * 0.6 + h4::INT * 0.3 + h5::INT * 0.6 + h2::INT * 0.6 + h6::INT * 0.3 + h7::INT * 0.6 + 0.3 * greatest(h1::INT + h2::INT + h3::INT + h4::INT + h5::INT + h6::INT + h7::INT - 1, 0) AS score FROM v), g AS (SELECT rule_set, count(*) AS windows, count_if(k > 0) AS observations, count_if(d >= 0.8 OR m >= 0.6 OR e >= 0.8) AS anomalies, count_if(d >= 0.8) AS disease_alerts, count_if(m >= 0.6) AS management_alerts, count_if(e >= 0.8) AS environment_alerts, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score FROM s GROUP BY 1)"
DETECTED = f"{tracks.WINDOWS}, r AS (SELECT *, error > (SELECT quantile_cont(error, 0.9) FROM v WHERE split = 'val') AS raw FROM v), {tracks.confirmed('split, pig', 'r', 'raw')}"
SUMMARY = "count(*) AS windows, round(avg(error), 5) AS mean_error, count_if(raw) AS raw, count_if(confirmed) AS confirmed, round(avg(raw::INT), 5) AS raw_rate, round(avg(confirmed::INT), 5) AS confirmed_rate FROM k GROUP BY ALL"
LEADS = "a AS (SELECT 'baseline' AS rule_set, chamber_id, start_datetime AS t FROM alerts WHERE final_alert UNION ALL SELECT 'candidate', chamber_id, start_datetime FROM alerts WHERE operational_alert), b AS (SELECT rule_set, event_id, min(epoch(start_datetime - t)) / 3600 AS least, max(epoch(start_datetime - t)) / 3600 AS first FROM farm_events JOIN a USING (chamber_id) WHERE t BETWEEN start_datetime - INTERVAL 72 HOUR AND start_datetime GROUP BY ALL), c AS (SELECT rule_set, count(*) AS matched, avg(first) AS m, count_if(least <= 24) AS c24, count_if(least <= 48) AS c48, count(*) AS c72 FROM b GROUP BY 1), n AS (SELECT rule_set, count(*) AS alert_windows FROM a GROUP BY 1), e AS (SELECT count(*) AS events FROM farm_events)"


def long(section: str, name: str, metrics: list[str], source: str) -> str:
    return f"SELECT '{section}' AS section, {name} AS name, unnest([{', '.join(repr(m) for m in metrics)}]) AS metric, unnest([{', '.join(f'{m}::DOUBLE' for m in metrics)}]) AS value FROM ({source})"


ORACLE_SQL = {
    "dom15_rule_sets": oracle("WITH " + sensor.WINDOWS.strip() + f", {SETS}, {HITS} SELECT g.*, " + ", ".join(f"g.{c} - b.{c} AS {c}_delta" for c in compare.COUNTS) + " FROM g, g AS b WHERE b.rule_set = 'baseline'"),
    "dom15_upgrade_lead": oracle(f"WITH {LEADS} SELECT rule_set, alert_windows, events, coalesce(matched, 0) AS lead_matched_events, round(m, 6) AS mean_first_lead_hours, round(coalesce(c24, 0) / events::DOUBLE, 6) AS recall_24h, round(coalesce(c48, 0) / events::DOUBLE, 6) AS recall_48h, round(coalesce(c72, 0) / events::DOUBLE, 6) AS recall_72h FROM n LEFT JOIN c USING (rule_set), e"),
    "dom13_overrides": oracle("WITH " + sensor.WINDOWS.strip() + sensor.hits_sql(1100.0) + " SELECT rule_reasons, count(*) AS n FROM scored GROUP BY 1"),
    "join02_raw_values": oracle("WITH " + sensor.SPLIT.strip() + " SELECT dataset_key, chamber_number, datetime, round(watersupply_mean, 6) AS watersupply_mean FROM tagged WHERE split = 'val'"),
    "join05_daily_timeline": oracle("SELECT pig_id, day, round(CASE WHEN day % 2 = 0 THEN rectal_temperature END, 6) AS rectal_temperature, (CASE WHEN pig_id % 3 > 0 THEN clinical END)::DOUBLE AS clinical, round(CASE WHEN pig_id % 5 > 1 THEN rectal_temperature * 2 - 70 END, 6) AS active, (CASE WHEN day > 4 THEN viral END)::DOUBLE AS viral, pig_id % 7 = 0 AND day > 9 AS treated FROM challenge WHERE day % 2 = 0 OR pig_id % 3 > 0 OR pig_id % 5 > 1 OR day > 4"),
    "join15_quality_flags": oracle("SELECT split, pig, seq, round(error, 5) AS error, count(*) OVER (PARTITION BY pig) < 20 AS low_confidence FROM scored_windows"),
    "agg17_animal_rollup": oracle("WITH h AS (SELECT pig_id, day, hour, sum(movement) AS v FROM activity GROUP BY ALL) SELECT pig_id, count(DISTINCT day) AS days, count(*) AS hours, round(sum(v), 4) AS total, round(avg(v), 4) AS mean, round(max(v), 4) AS largest FROM h GROUP BY 1"),
    "agg17_pig_days": oracle("SELECT count(DISTINCT (pig_id, day)) AS observed, count(DISTINCT pig_id) * count(DISTINCT day) AS possible, round(count(DISTINCT (pig_id, day)) / (count(DISTINCT pig_id) * count(DISTINCT day))::DOUBLE, 6) AS coverage FROM activity"),
    "agg17_largest_drops": oracle("WITH h AS (SELECT pig_id, day, sum(movement) AS t FROM activity GROUP BY ALL), c AS (SELECT pig_id, day, t, t / nullif(lag(t) OVER (PARTITION BY pig_id ORDER BY day), 0) - 1 AS x FROM h) SELECT pig_id, day, round(t, 4) AS total, round(x, 4) AS total_change FROM c WHERE x IS NOT NULL ORDER BY x, pig_id, day LIMIT 5"),
    "agg39_by_animal": oracle(f"WITH {DETECTED} SELECT split, pig, {SUMMARY}"),
    "agg39_by_day": oracle(f"WITH {DETECTED} SELECT split, (seq // 100 + 1)::BIGINT AS elapsed_day, {SUMMARY}"),
    "agg40_temperature_series": oracle("WITH " + sensor.HOURLY.strip() + " SELECT dataset_key, chamber_number, datetime, 'barn' AS series, round(barn_temperature_mean, 6) AS value FROM hourly WHERE barn_temperature_mean IS NOT NULL UNION ALL SELECT dataset_key, chamber_number, datetime, 'rectal', round(rectal_temperature_mean, 6) FROM hourly WHERE rectal_temperature_mean IS NOT NULL"),
    "dom19_performance_rows": oracle(long("policy", "policy", BURDEN, pens.BURDEN) + " UNION ALL " + long("score", "concat(score, ' ', threshold)", SCORES, pens.SWEEP + " SELECT * FROM t")),
    "prj03_clip_parts": "SELECT o_orderkey, o_orderdate::DATE AS clip_date, o_orderkey % 5 AS channel, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS facility, o_orderkey % 7 AS pen, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 6 WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 END AS chamber FROM orders",
    "prj11_usable_features": "SELECT 'l_quantity' AS feature, count(l_quantity) AS rows FROM lineitem UNION ALL SELECT 'l_tax', count(CASE WHEN l_linenumber > 3 THEN l_tax END) FROM lineitem",
    "prj02_coerced": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN l_quantity::DOUBLE END AS quantity, NULL::DOUBLE AS absent FROM lineitem",
    "prj01_time_index": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::TIMESTAMP ELSE (CASE WHEN year(o_orderdate) < 2000 THEN o_orderdate::DATE + INTERVAL 100 YEAR ELSE o_orderdate::DATE END)::TIMESTAMP + INTERVAL '570' MINUTE END AS datetime FROM orders WHERE o_orderkey % 4 < 3",
    "prj05_model_ready": oracle("SELECT facility, pen, count(*) AS n, max(center_x) AS center_x FROM points WHERE point_count % 2 = 0 GROUP BY 1, 2"),
    "dom04_activity_track": oracle("WITH t AS (SELECT *, 0.5::DOUBLE * least(track_score / 0.25::DOUBLE, 2.0) AS p FROM alerts) SELECT chamber_id, CASE WHEN p >= 1.5 THEN 'high' WHEN p >= 0.8 THEN 'medium' ELSE 'normal' END AS tier, CASE WHEN model_anomaly THEN 'disease' ELSE '' END AS alert_category, count(*) AS n, round(max(p), 6) AS top, count_if(low_confidence) AS low FROM t GROUP BY ALL"),
    "src13_wearable": "SELECT user_id AS pig_id, count(*) AS n, CASE WHEN user_id % 5 > 0 THEN count(*) ELSE 0 END AS timed, CASE WHEN user_id % 5 > 0 THEN max(ts)::TIMESTAMP END AS last, max(value) AS heart_rate FROM events GROUP BY 1",
}
