"""Queries of names, composite operators and evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from penlight.functions import names
from penlight.operators import composite, evaluate, quality
from penlight.plans import pens, sensor
from penlight.sources.adapters import oracle, rounded, table

PATHS = ("data/Training/breath/a.json", "data/validation/temp/b.json", "x/test/feed/c.json", "x/y/z.json")


def name_parts(spark, sf_dir):
    n = F.col("o_orderkey")
    path = F.element_at(F.array(*[F.lit(p) for p in PATHS]), (n % 4 + 1).cast("int"))
    image = F.when(n % 5 == 0, "broken.jpg").otherwise(F.concat(F.lit("F"), (n % 3).cast("string"), F.lit("_CH02_2023010510_0003_"), n.cast("string"), F.lit(".jpg")))
    p = names.image_parts(image)
    rows = table(spark, sf_dir, "orders").select(names.split_of(path).alias("split"), names.kind_of(path).alias("kind"), names.housing(F.when(n % 2 == 0, "Pair housed")).alias("housing"), p["farm_id"].alias("farm_id"), names.frame_time(p["hour"], p["frame"]).alias("time"))
    return rows.groupBy("split", "kind", "housing", "farm_id").agg(F.count("*").alias("n"), F.max("time").alias("last"))


def image_features(spark, sf_dir):
    rows = table(spark, sf_dir, "points").select("facility", "frame_id", F.col("label").alias("action"), (F.col("point_count") % 2).alias("estrus"), "center_x", "center_y")
    return rounded(composite.image_features(rows, ["facility"], "frame_id", ["walking", "lying"]), "walking_ratio", "lying_ratio", "estrus_ratio", "center_x", "center_y", "movement", places=4)


def animal_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("pig"), F.col("ts").alias("datetime"), "value", F.when(F.col("event_type") < "d", "hot").otherwise("cool").alias("condition"))
    return rounded(composite.resampled_animals(rows, ["pig"], "datetime", ["value"], ["value"], "condition", 86400), "value", "value_std", places=5)


def elapsed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("pig"), F.col("ts").alias("datetime"))
    return composite.elapsed_day(rows, ["pig"], "datetime").groupBy("pig", "elapsed_day").agg(F.count("*").alias("n"))


def category_risk(spark, sf_dir):
    from penlight.operators import rules

    found = rules.evaluate(sensor.raw_windows(spark, sf_dir), sensor.RULES, sensor.WINDOW)
    return rounded(composite.category_risk(found, ["disease", "management", "environment"]), "mean_score", "max_score")


def best_hit(spark, sf_dir):
    rows = pens.scored(spark, sf_dir).withColumn("rule_score", F.round(F.col("rule_score") + 3e-9, 6))
    return composite.best_hit(rows, ["feed_drop", "co2_high"], "rule_reasons", "rule_score", pens.KEYS).select(*pens.KEYS, "rule_score", "rule_reasons")


def examples(spark, sf_dir):
    found = composite.policy_examples(table(spark, sf_dir, "pen_day"), "temperature_max", pens.POLICIES, pens.KEYS, 20)
    return found.select("policy", "rank", *pens.KEYS, "temperature_max")


def injections(spark, sf_dir):
    cases = {"none": {}, "fever": {"rectal_temperature_mean_corrected__wmax": 42.0}, "gas": {"co2_mean__wmax": 5000.0, "barn_temperature_mean__wmax": 36.0}}
    found = composite.injected(sensor.raw_windows(spark, sf_dir), cases, sensor.RULES, sensor.WINDOW)
    return rounded(found.groupBy("case", "rule_reasons").agg(F.count("*").alias("n"), F.max("rule_score").alias("rule_score")), "rule_score")


def gated(spark, sf_dir):
    mask = pens.frame(spark, sf_dir).select(*pens.KEYS, (F.col("baseline_alert") | F.col("recent_same_reason")).alias("precision_alert")).where("month(date) > 2")
    return composite.gated(pens.scored(spark, sf_dir), mask, pens.KEYS).groupBy("precision_alert", "suppressed").agg(F.count("*").alias("n"))


def expected_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "reviews").select(F.col("queue").alias("expected_rule"), (F.col("review_status") == "confirmed").alias("hit"), "followup_required")
    return rounded(composite.expected_recall({"early": rows.where("followup_required = 'y'"), "late": rows.where("followup_required = 'n'")}), "recall")


def clean_counts(spark, sf_dir):
    hourly = sensor.hourly(spark, sf_dir)
    confirmed = hourly.where("rectal_temperature_mean > 40.9").select("chamber_number", F.col("datetime").alias("start_datetime"), (F.col("datetime") + F.expr("INTERVAL 2 HOURS")).alias("end_datetime"))
    return composite.clean_inputs(hourly, confirmed, "chamber_number", ["watersupply_mean"], sensor.KEYS, sensor.LENGTH)[2]


def track_inputs(spark, sf_dir):
    """Window matrices of a track by entity and split; rows only."""
    inputs, _ = composite.track_inputs(sensor.hourly(spark, sf_dir), ["watersupply_mean", "co2_mean"], sensor.KEYS, sensor.LENGTH)
    return inputs.groupBy(*sensor.KEYS, "split").agg(F.count("*").alias("windows"), F.max("end_datetime").alias("last"))


def error_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "scored_windows")
    return rounded(composite.grouped_errors(rows, ["split"]), "min_error", "median_error", "mean_error", "max_error", places=5)


def event_summary(spark, sf_dir):
    return rounded(composite.event_summary(table(spark, sf_dir, "farm_events"), ["event_type"]), "mean_severity")


def sentinels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("heart"), (F.col("l_discount") * 100).alias("skin"))
    masked = quality.sentinel_masked(rows, ["heart", "skin"], [1.0, 50.0, 0.0], ["skin"])
    counts = quality.sentinel_counts(rows, ["heart", "skin"], [1.0, 50.0])
    held = masked.agg(F.count("heart").alias("heart"), F.count("skin").alias("skin")).unpivot([], ["heart", "skin"], "column", "kept")
    return rounded(counts.join(held.hint("merge"), "column"), "sentinel_pct")


def shared(spark, sf_dir):
    return composite.shared_features(table(spark, sf_dir, "pen_day"), table(spark, sf_dir, "visits"))


def splits(spark, sf_dir):
    rows = table(spark, sf_dir, "scored_windows").drop("split")
    return composite.tagged_union({"clean": rows.where("error < 0.2"), "odd": rows.where("error >= 0.2")}).groupBy("split").agg(F.count("*").alias("n"))


def evidence(spark, sf_dir):
    heat = evaluate.confusion(pens.pen_days(spark, sf_dir), "temperature_max", 31.6, "heat_signs")
    return composite.evidence({"heat rule": (heat, "sensitivity {sensitivity} precision {precision}"), "days": (table(spark, sf_dir, "pen_day").agg(F.count("*").cast("double").alias("n")), "pen-days {n}")})


def labelled_confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labelled").withColumn("bad", F.col("quality") == 0)
    return rounded(evaluate.confusion(rows, "n_chars", 900.0, "bad", above=False), *pens.RATES)


QUERIES = {
    "prj04_name_parts": name_parts, "agg06_image_features": image_features, "agg08_animal_bins": animal_bins, "win18_elapsed_day": elapsed, "agg38_category_risk": category_risk, "top05_best_hit": best_hit, "top06_examples": examples, "dom16_injections": injections,
    "dom10_precision_gate": gated, "dom20_expected_recall": expected_recall, "ml07_clean_counts": clean_counts, "ml09_track_inputs": track_inputs, "agg37_error_rollup": error_rollup, "agg29_event_summary": event_summary, "prj08_sentinels": sentinels, "set05_shared_features": shared,
    "set04_tagged_splits": splits, "evl11_evidence": evidence, "evl02_labelled_confusion": labelled_confusion,
}
ORACLE_SQL = {
    "prj04_name_parts": "SELECT ['train', 'val', 'test', 'unknown'][o_orderkey % 4 + 1] AS split, ['breathing', 'temperature', 'feeding', 'other'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'Pair' ELSE 'Isolation' END AS housing, CASE WHEN o_orderkey % 5 <> 0 THEN concat('F', o_orderkey % 3) END AS farm_id, count(*) AS n, max(CASE WHEN o_orderkey % 5 <> 0 THEN TIMESTAMP '2023-01-05 10:00:00' + to_microseconds(round(o_orderkey / 30.0::DOUBLE * 1000000)::BIGINT) END) AS last FROM orders GROUP BY 1, 2, 3, 4",
    "agg06_image_features": oracle("WITH p AS (SELECT facility, frame_id, count(*) AS annotations, avg((label = 'walking')::INT) AS a, avg((label = 'lying')::INT) AS b, avg(point_count % 2) AS e, avg(center_x) AS x, avg(center_y) AS y FROM points GROUP BY ALL) SELECT facility, frame_id, annotations, round(a, 4) AS walking_ratio, round(b, 4) AS lying_ratio, round(e, 4) AS estrus_ratio, round(x, 4) AS center_x, round(y, 4) AS center_y, round(coalesce(sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2), 0), 4) AS movement FROM p WINDOW o AS (PARTITION BY facility ORDER BY frame_id)"),
    "agg08_animal_bins": "SELECT user_id % 60 AS pig, date_trunc('day', ts)::TIMESTAMP AS datetime, round(avg(value) + 3e-9, 5) AS value, round(stddev_samp(value) + 3e-9, 5) AS value_std, count(*) AS source_rows, CASE WHEN 2 * count(CASE WHEN event_type < 'd' THEN 1 END) > count(*) THEN 'hot' ELSE 'cool' END AS condition FROM events GROUP BY 1, 2",
    "win18_elapsed_day": "WITH e AS (SELECT user_id % 60 AS pig, (epoch_us(ts) // 1000000 - epoch_us(min(ts) OVER (PARTITION BY user_id % 60)) // 1000000) // 86400 + 1 AS elapsed_day FROM events) SELECT pig, elapsed_day::BIGINT AS elapsed_day, count(*) AS n FROM e GROUP BY 1, 2",
    "agg38_category_risk": oracle("WITH " + sensor.WINDOWS.strip() + sensor.hits_sql() + " " + " UNION ALL ".join(f"SELECT '{c}' AS category, count_if({c}_rule_score >= {t}) AS alerts, round(avg({c}_rule_score), 6) AS mean_score, round(max({c}_rule_score), 6) AS max_score FROM scored" for c, t in (("disease", 0.8), ("management", 0.6), ("environment", 0.8)))),
    "top05_best_hit": oracle("WITH " + pens.BASE.strip() + " SELECT experiment, pen_id, date, rule_score, rule_reasons FROM scored WHERE r1 AND r2 ORDER BY rule_score DESC, experiment, pen_id, date LIMIT 1"),
    "top06_examples": oracle("SELECT p.policy, row_number() OVER (PARTITION BY p.policy ORDER BY temperature_max DESC, experiment, pen_id, date)::INT AS rank, experiment, pen_id, date, temperature_max FROM pen_day, (VALUES ('screening', 28.7::DOUBLE), ('balanced', 30.4), ('high_confidence', 31.6)) p(policy, threshold) WHERE temperature_max >= p.threshold QUALIFY row_number() OVER (PARTITION BY p.policy ORDER BY temperature_max DESC, experiment, pen_id, date) <= 20"),
    "dom10_precision_gate": oracle(pens.CONTEXT + ", g AS (SELECT CASE WHEN month(date) > 2 THEN baseline_alert OR recent_same_reason ELSE true END AS precision_alert, b.rule_score > 0 AS scored FROM base b JOIN r USING (experiment, pen_id, date)) SELECT precision_alert, NOT precision_alert AND scored AS suppressed, count(*) AS n FROM g GROUP BY ALL"),
    "dom20_expected_recall": oracle("SELECT CASE followup_required WHEN 'y' THEN 'early' ELSE 'late' END AS set, queue AS expected_rule, count(*) AS events, count_if(review_status = 'confirmed') AS hits, round(avg((review_status = 'confirmed')::INT), 6) AS recall FROM reviews GROUP BY 1, 2"),
    "ml07_clean_counts": oracle("WITH " + sensor.HOURLY.strip() + ", c AS (SELECT chamber_number, datetime AS a FROM hourly WHERE rectal_temperature_mean > 40.9) SELECT (SELECT count(*) FROM hourly) AS rows_before, count(*) AS rows_after FROM hourly h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.chamber_number = h.chamber_number AND h.datetime BETWEEN c.a AND c.a + INTERVAL 2 HOUR)"),
    "agg37_error_rollup": oracle("SELECT split, count(*) AS windows, round(min(error), 5) AS min_error, round(quantile_cont(error, 0.5), 5) AS median_error, round(avg(error), 5) AS mean_error, round(max(error), 5) AS max_error FROM scored_windows GROUP BY 1"),
    "agg29_event_summary": oracle("SELECT event_type, count(*) AS events, round(avg(severity), 6) AS mean_severity, max(severity) AS max_severity FROM farm_events GROUP BY 1"),
    "prj08_sentinels": "SELECT 'heart' AS column, count(CASE WHEN l_quantity IN (1, 50) THEN 1 END) AS sentinels, round(100.0 * count(CASE WHEN l_quantity IN (1, 50) THEN 1 END) / count(*)::DOUBLE + 3e-9, 6) AS sentinel_pct, count(CASE WHEN l_quantity NOT IN (1, 50, 0) THEN 1 END) AS kept FROM lineitem UNION ALL SELECT 'skin', count(CASE WHEN l_discount * 100 IN (1.0::DOUBLE, 50.0::DOUBLE) THEN 1 END), round(100.0 * count(CASE WHEN l_discount * 100 IN (1.0::DOUBLE, 50.0::DOUBLE) THEN 1 END) / count(*)::DOUBLE + 3e-9, 6), count(CASE WHEN l_discount * 100 NOT IN (1.0::DOUBLE, 50.0::DOUBLE) AND l_discount > 0 THEN 1 END) FROM lineitem",
    "set05_shared_features": "SELECT unnest(['experiment', 'pen_id', 'date']) AS feature",
    "set04_tagged_splits": oracle("SELECT CASE WHEN error < 0.2 THEN 'clean' ELSE 'odd' END AS split, count(*) AS n FROM scored_windows GROUP BY 1"),
    "dom16_injections": oracle("WITH " + sensor.WINDOWS.strip() + ", base AS (SELECT f_mean, w_mean, t_max, b_max, c_max FROM full_windows), v AS (SELECT 'none' AS c, * FROM base UNION ALL SELECT 'fever', f_mean, w_mean, 42.0, b_max, c_max FROM base UNION ALL SELECT 'gas', f_mean, w_mean, t_max, 36.0, 5000.0 FROM base), h AS (SELECT c, coalesce(t_max >= 41.0, false) AS h1, coalesce(b_max >= 40.0, false) AS h2, coalesce(f_mean <= -0.1, false) AS h3, coalesce(w_mean >= 0.1, false) AS h4, coalesce(w_mean <= -0.1, false) AS h5, coalesce(c_max >= 1000.0, false) AS h6, coalesce(b_max >= 35.0, false) AND coalesce(c_max >= 950.0, false) AS h7 FROM v), s AS (SELECT c, concat_ws(',', CASE WHEN h1 THEN 'rectal_temp_high' END, CASE WHEN h2 THEN 'barn_temp_high' END, CASE WHEN h3 THEN 'feed_drop' END, CASE WHEN h4 THEN 'water_spike' END, CASE WHEN h5 THEN 'water_drop' END, CASE WHEN h6 THEN 'co2_high' END, CASE WHEN h7 THEN 'barn_hot_with_co2_high' END) AS rule_reasons, h1::INT * 1.0::DOUBLE + h2::INT * 0.6 + h3::INT * 0.6 + h4::INT * 0.3 + h5::INT * 0.6 + h6::INT * 0.3 + h7::INT * 0.6 + 0.3 * greatest(h1::INT + h2::INT + h3::INT + h4::INT + h5::INT + h6::INT + h7::INT - 1, 0) AS x FROM h) SELECT c AS \"case\", rule_reasons, count(*) AS n, round(max(x), 6) AS rule_score FROM s GROUP BY ALL"),
    "ml09_track_inputs": oracle("WITH " + sensor.SIZES.strip() + ", o AS (SELECT *, row_number() OVER (PARTITION BY dataset_key, chamber_number ORDER BY datetime) AS i FROM hourly JOIN t USING (dataset_key, chamber_number) WHERE total_rows >= 24 AND train >= 24 AND val >= 24), x AS (SELECT *, 'train' AS split FROM o WHERE i <= train UNION ALL SELECT *, 'val' FROM o WHERE i > total_rows - val) SELECT dataset_key, chamber_number, split, count(*) - 23 AS windows, max(datetime) AS last FROM x GROUP BY ALL HAVING count(*) >= 24"),
    "evl11_evidence": oracle("WITH " + pens.BASE.strip() + ", h AS (SELECT temperature_max >= 31.6 AS a, heat_signs AS b FROM scored) SELECT 'heat rule' AS title, concat_ws(' ', 'sensitivity', coalesce(round(count_if(a AND b) / nullif(count_if(b), 0)::DOUBLE, 3)::VARCHAR, '-'), 'precision', coalesce(round(count_if(a AND b) / nullif(count_if(a), 0)::DOUBLE, 3)::VARCHAR, '-')) AS text FROM h UNION ALL SELECT 'days', concat_ws(' ', 'pen-days', round(count(*)::DOUBLE, 3)::VARCHAR) FROM pen_day"),
    "evl02_labelled_confusion": oracle("WITH h AS (SELECT n_chars <= 900 AS on_, quality = 0 AS any_signs FROM labelled) " + pens.rates(f"SELECT {pens.COUNTS} FROM h")),
}
