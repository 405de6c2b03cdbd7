"""Queries of the sensor track: readings to windows, rules and chambers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penlight.operators import alerts, quality, rules, series
from penlight.sources.adapters import oracle, rounded, table

KEYS = ["dataset_key", "chamber_number"]
WINDOW = [*KEYS, "start_datetime", "end_datetime"]
FEATURES = ["feedstuff_volume", "watersupply", "barn_temperature", "co2", "rectal_temperature"]
LENGTH = 24
RANGES = {"rectal_temperature_mean": (35.0, 41.9), "barn_temperature_mean": (-10.0, 44.0)}
#: The rule set at thresholds that fit the shape of the given tables.
RULES = [
    {"id": "rectal_temp_high", "feature": "rectal_temperature_mean_corrected", "agg": "max", "op": ">=", "threshold": 41.0, "severity": "high", "category": "disease"},
    {"id": "barn_temp_high", "feature": "barn_temperature_mean", "agg": "max", "op": ">=", "threshold": 40.0, "severity": "medium", "category": "environment"},
    {"id": "feed_drop", "feature": "feedstuff_volume_mean_zscore_3d", "agg": "mean", "op": "<=", "threshold": -0.1, "severity": "medium", "category": "management"},
    {"id": "water_spike", "feature": "watersupply_mean_zscore_3d", "agg": "mean", "op": ">=", "threshold": 0.1, "severity": "low", "category": "management"},
    {"id": "water_drop", "feature": "watersupply_mean_zscore_3d", "agg": "mean", "op": "<=", "threshold": -0.1, "severity": "medium", "category": "management"},
    {"id": "co2_high", "feature": "co2_mean", "agg": "max", "op": ">=", "threshold": 1000.0, "severity": "low", "category": "environment"},
    {"id": "barn_hot_with_co2_high", "severity": "medium", "category": "environment", "all_of": [{"feature": "barn_temperature_mean", "agg": "max", "op": ">=", "threshold": 35.0}, {"feature": "co2_mean", "agg": "max", "op": ">=", "threshold": 950.0}]},
]


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.two_level_mean(table(spark, sf_dir, "readings"), FEATURES, [*KEYS, "datetime"], "pig_number", ["feedstuff_volume"])


def raw_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked and corrected readings with rolling statistics, as windows of 24 rows."""
    masked = quality.implausible_masked(hourly(spark, sf_dir), RANGES)
    fit = rules.barn_correction(masked, "rectal_temperature_mean", "barn_temperature_mean")
    rows = rules.corrected(masked, fit, "rectal_temperature_mean", "barn_temperature_mean")
    rolled = series.rolling_features(rows, ["feedstuff_volume_mean", "watersupply_mean"], KEYS)
    features = ["rectal_temperature_mean_corrected", "barn_temperature_mean", "co2_mean", "feedstuff_volume_mean_zscore_3d", "watersupply_mean_zscore_3d"]
    return series.window_table(rolled, features, KEYS, LENGTH)


def agg_two_level_mean(spark, sf_dir):
    return rounded(hourly(spark, sf_dir), *[f"{c}_mean" for c in FEATURES], "feedstuff_volume_std")


HOURLY = """
per_pig AS (SELECT dataset_key, chamber_number, datetime, pig_number, avg(feedstuff_volume) f, avg(watersupply) w, avg(barn_temperature) b, avg(co2) c, avg(rectal_temperature) r, count(*) n FROM readings GROUP BY ALL),
hourly AS (SELECT dataset_key, chamber_number, datetime, avg(f) AS feedstuff_volume_mean, avg(w) AS watersupply_mean, avg(b) AS barn_temperature_mean, avg(c) AS co2_mean, avg(r) AS rectal_temperature_mean,
  coalesce(stddev_samp(f), 0) AS feedstuff_volume_std, count(pig_number) AS pig_count, sum(n)::BIGINT AS frame_count FROM per_pig GROUP BY ALL)"""
ROLLED = HOURLY + """,
masked AS (SELECT * REPLACE (CASE WHEN rectal_temperature_mean BETWEEN 35 AND 41.9 THEN rectal_temperature_mean END AS rectal_temperature_mean, CASE WHEN barn_temperature_mean BETWEEN -10 AND 44 THEN barn_temperature_mean END AS barn_temperature_mean) FROM hourly),
fit AS (SELECT CASE WHEN count(*) < 10 THEN 0 ELSE coalesce(regr_slope(rectal_temperature_mean, barn_temperature_mean), 0) END AS slope, CASE WHEN count(*) < 10 THEN avg(rectal_temperature_mean) ELSE regr_intercept(rectal_temperature_mean, barn_temperature_mean) END AS intercept,
  CASE WHEN count(*) < 10 THEN 0 ELSE coalesce(corr(rectal_temperature_mean, barn_temperature_mean), 0) END AS pearson_corr, count(*) AS n_rows FROM masked WHERE rectal_temperature_mean IS NOT NULL AND barn_temperature_mean IS NOT NULL),
corrected AS (SELECT m.*, rectal_temperature_mean - slope * (barn_temperature_mean - 26) AS corr_t FROM masked m, fit),
rolled AS (SELECT *, avg(feedstuff_volume_mean) OVER w AS fm, stddev_samp(feedstuff_volume_mean) OVER w AS fs, avg(watersupply_mean) OVER w AS wm, stddev_samp(watersupply_mean) OVER w AS ws,
  lag(feedstuff_volume_mean) OVER o AS fl, lag(watersupply_mean) OVER o AS wl FROM corrected
  WINDOW w AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime RANGE BETWEEN INTERVAL '71 hours 59 minutes' PRECEDING AND CURRENT ROW), o AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime)),
z AS (SELECT *, coalesce((feedstuff_volume_mean - fm) / nullif(fs, 0), 0) AS fz, coalesce((watersupply_mean - wm) / nullif(ws, 0), 0) AS wz FROM rolled)"""
WINDOWS = ROLLED + """,
win AS (SELECT dataset_key, chamber_number, datetime AS start_datetime, lead(datetime, 23) OVER o AS end_datetime, row_number() OVER o - 1 AS window_start_index, count(*) OVER a AS n,
  max(corr_t) OVER a AS t_max, max(barn_temperature_mean) OVER a AS b_max, avg(barn_temperature_mean) OVER a AS b_mean, min(barn_temperature_mean) OVER a AS b_min, max(co2_mean) OVER a AS c_max, avg(fz) OVER a AS f_mean, avg(wz) OVER a AS w_mean FROM z
  WINDOW o AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime), a AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)),
full_windows AS (SELECT * FROM win WHERE n = 24)"""


def hits_sql(co2: float = 1000.0) -> str:
    return f""",
hits AS (SELECT dataset_key, chamber_number, start_datetime, end_datetime, coalesce(t_max >= 41.0, false) AS h1, coalesce(b_max >= 40.0, false) AS h2, coalesce(f_mean <= -0.1, false) AS h3, coalesce(w_mean >= 0.1, false) AS h4, coalesce(w_mean <= -0.1, false) AS h5,
  coalesce(c_max >= {co2}, false) AS h6, coalesce(b_max >= 35.0, false) AND coalesce(c_max >= 950.0, false) AS h7 FROM full_windows),
counted AS (SELECT *, h1::INT + h2::INT + h3::INT + h4::INT + h5::INT + h6::INT + h7::INT AS k, h2::INT + h6::INT + h7::INT AS ke, h3::INT + h4::INT + h5::INT AS km,
  h1::INT * 1.0::DOUBLE AS sd, h3::INT * 0.6::DOUBLE + h4::INT * 0.3::DOUBLE + h5::INT * 0.6::DOUBLE AS sm, h2::INT * 0.6::DOUBLE + h6::INT * 0.3::DOUBLE + h7::INT * 0.6::DOUBLE AS se FROM hits),
scored AS (SELECT *, round(sd + sm + se + 0.3 * greatest(k - 1, 0), 6) AS rule_score, round(sd, 6) AS disease_rule_score, round(sm + 0.3 * greatest(km - 1, 0), 6) AS management_rule_score, round(se + 0.3 * greatest(ke - 1, 0), 6) AS environment_rule_score,
  concat_ws(',', CASE WHEN h1 THEN 'rectal_temp_high' END, CASE WHEN h2 THEN 'barn_temp_high' END, CASE WHEN h3 THEN 'feed_drop' END, CASE WHEN h4 THEN 'water_spike' END, CASE WHEN h5 THEN 'water_drop' END, CASE WHEN h6 THEN 'co2_high' END, CASE WHEN h7 THEN 'barn_hot_with_co2_high' END) AS rule_reasons,
  concat_ws(',', CASE WHEN h3 THEN 'feed_drop' END, CASE WHEN h4 THEN 'water_spike' END, CASE WHEN h5 THEN 'water_drop' END) AS mr, concat_ws(',', CASE WHEN h2 THEN 'barn_temp_high' END, CASE WHEN h6 THEN 'co2_high' END, CASE WHEN h7 THEN 'barn_hot_with_co2_high' END) AS er FROM counted)"""


def rolling(spark, sf_dir):
    rolled = series.rolling_features(hourly(spark, sf_dir), ["feedstuff_volume_mean"], KEYS)
    names = ["feedstuff_volume_mean_roll_mean_3d", "feedstuff_volume_mean_roll_std_3d", "feedstuff_volume_mean_zscore_3d", "feedstuff_volume_mean_delta"]
    return rounded(rolled.select(*KEYS, "datetime", *names), *names, places=5)


def windows(spark, sf_dir):
    rows = raw_windows(spark, sf_dir).select(*WINDOW, "window_start_index", F.col("barn_temperature_mean__wmean").alias("b_mean"), F.col("barn_temperature_mean__wmax").alias("b_max"), F.col("barn_temperature_mean__wmin").alias("b_min"))
    return rounded(rows, "b_mean", "b_max", "b_min")


def rule_evaluation(spark, sf_dir):
    found = rules.evaluate(raw_windows(spark, sf_dir), RULES, WINDOW)
    names = ["rule_score", "disease_rule_score", "management_rule_score", "environment_rule_score"]
    return rounded(found.select(*WINDOW, "rule_reasons", "rule_triggered_count", *names, "rule_anomaly", "rule_observation"), *names)


def with_model(spark, sf_dir):
    """Windows with a model's errors; every third window has one."""
    found = rules.evaluate(raw_windows(spark, sf_dir), RULES, WINDOW)
    hour = F.unix_seconds(F.col("start_datetime").cast("timestamp")) / 3600
    model = raw_windows(spark, sf_dir).where(hour.cast("long") % 3 == 0).select(*WINDOW, (hour.cast("long") % 7 / 2.0).alias("reconstruction_error"), F.lit(1.25).alias("threshold"), (hour.cast("long") % 7 >= 5).alias("confirmed_anomaly"))
    return rules.combine(found, model, WINDOW)


COMBINED = """,
model AS (SELECT *, epoch(start_datetime)::BIGINT // 3600 AS h FROM scored),
combined AS (SELECT *, CASE WHEN h % 3 = 0 THEN least((h % 7 / 2.0::DOUBLE) / 1.25, 2.0) * 0.5 ELSE 0.0 END AS model_component, h % 3 = 0 AND h % 7 >= 5 AS model_anomaly,
  disease_rule_score >= 0.8 AS da, management_rule_score >= 0.6 AS ma, environment_rule_score >= 0.8 AS ea FROM model)"""


def combined(spark, sf_dir):
    names = ["model_component", "disease_score"]
    return rounded(with_model(spark, sf_dir).select(*WINDOW, "model_component", "model_anomaly", "disease_score", "disease_tier", "final_alert", "alert_category", "primary_reason"), *names)


def flagship(spark, sf_dir):
    """Readings to one scored row for each chamber."""
    rows = with_model(spark, sf_dir).select(
        F.lit("barn").alias("track"), F.col("dataset_key").alias("source_dataset"), F.concat_ws(":", "dataset_key", F.col("chamber_number").cast("string")).alias("chamber_id"), "start_datetime", "end_datetime",
        F.col("disease_score").alias("track_score"), "management_score", "environment_score", "model_anomaly", "rule_anomaly", F.col("disease_tier").alias("tier"), F.lit(False).alias("low_confidence"))
    return rounded(alerts.chamber_rollup(alerts.final_table([rows])), "mean_score", "max_score")


def experiments(spark, sf_dir):
    variants = {"baseline": {}, "co2_1200": {"co2_high": 1200.0}, "fever_41_5": {"rectal_temp_high": 41.5}}
    return rounded(rules.experiments(raw_windows(spark, sf_dir), RULES, variants, WINDOW), "mean_disease_score", "max_disease_score")


EXPERIMENT = """
SELECT '{name}' AS experiment, count(*) AS windows, count_if(k > 0) AS rule_observation, count_if({d} OR management_rule_score >= 0.6 OR {e}) AS rule_anomaly, count_if({d}) AS disease_alert, count_if(management_rule_score >= 0.6) AS management_alert, count_if({e}) AS environment_alert,
  round(avg({ds}), 6) AS mean_disease_score, round(max({ds}), 6) AS max_disease_score FROM {t}"""


def experiment_oracle() -> str:
    variants = (("baseline", "t_max >= 41.0", "c_max >= 1000.0"), ("co2_1200", "t_max >= 41.0", "c_max >= 1200.0"), ("fever_41_5", "t_max >= 41.5", "c_max >= 1000.0"))
    rows = " UNION ALL ".join(f"SELECT '{n}' AS experiment, *, coalesce({t}, false) AS h1, coalesce({c}, false) AS h6 FROM base" for n, t, c in variants)
    return oracle("WITH " + WINDOWS.strip() + f""",
base AS (SELECT coalesce(b_max >= 40.0, false) AS h2, coalesce(f_mean <= -0.1, false) AS h3, coalesce(w_mean >= 0.1, false) AS h4, coalesce(w_mean <= -0.1, false) AS h5, t_max, c_max, coalesce(b_max >= 35.0, false) AND coalesce(c_max >= 950.0, false) AS h7 FROM full_windows),
v AS ({rows}),
s AS (SELECT experiment, h1 OR h2 OR h3 OR h4 OR h5 OR h6 OR h7 AS o, h1::INT * 1.0::DOUBLE AS d, round(h3::INT * 0.6 + h4::INT * 0.3 + h5::INT * 0.6 + 0.3 * greatest(h3::INT + h4::INT + h5::INT - 1, 0), 6) >= 0.6 AS m, round(h2::INT * 0.6 + h6::INT * 0.3 + h7::INT * 0.6 + 0.3 * greatest(h2::INT + h6::INT + h7::INT - 1, 0), 6) >= 0.8 AS e FROM v),
g AS (SELECT experiment, count(*) AS windows, count_if(o) AS rule_observation, count_if(d >= 0.8 OR m OR e) AS rule_anomaly, count_if(d >= 0.8) AS disease_alert, count_if(m) AS management_alert, count_if(e) AS environment_alert, round(avg(d), 6) AS mean_disease_score, round(max(d), 6) AS max_disease_score FROM s GROUP BY 1),
b AS (SELECT * FROM g WHERE experiment = 'baseline'),
x AS (SELECT g.*, g.rule_observation - b.rule_observation AS rule_observation_delta, g.rule_anomaly - b.rule_anomaly AS rule_anomaly_delta, g.disease_alert - b.disease_alert AS disease_alert_delta, g.management_alert - b.management_alert AS management_alert_delta, g.environment_alert - b.environment_alert AS environment_alert_delta FROM g, b)
SELECT *, CASE WHEN experiment = 'baseline' THEN 'baseline' WHEN disease_alert_delta < 0 THEN 'reject_disease_loss' WHEN environment_alert_delta < 0 AND disease_alert_delta = 0 THEN 'candidate_environment_tightening' WHEN rule_anomaly_delta = 0 THEN 'no_alert_change' ELSE 'review_manually' END AS experiment_recommendation FROM x""")


def barn_fit(spark, sf_dir):
    masked = quality.implausible_masked(hourly(spark, sf_dir), RANGES)
    return rounded(rules.barn_correction(masked, "rectal_temperature_mean", "barn_temperature_mean").drop("reference_barn_temp"), "slope", "intercept", "pearson_corr")


def masking(spark, sf_dir):
    return quality.implausible_counts(hourly(spark, sf_dir), RANGES)


def imputation(spark, sf_dir):
    means = [f"{c}_mean" for c in FEATURES]
    return rounded(quality.imputed(hourly(spark, sf_dir), means).select(*KEYS, "datetime", *means), *means)


def imputation_report(spark, sf_dir):
    return quality.imputation_report(hourly(spark, sf_dir), [f"{c}_mean" for c in FEATURES])


def missing(spark, sf_dir):
    return rounded(quality.missing_by_column(hourly(spark, sf_dir), [f"{c}_mean" for c in FEATURES]), "missing_pct")


def dense(spark, sf_dir):
    return rounded(series.dense_bins(table(spark, sf_dir, "readings"), ["watersupply", "feedstuff_volume"], KEYS, 7200), "watersupply", "feedstuff_volume")


def interpolation(spark, sf_dir):
    bins = series.dense_bins(table(spark, sf_dir, "readings"), ["watersupply"], KEYS, 7200)
    return rounded(series.interpolated(bins, ["watersupply"], KEYS), "watersupply")


DENSE = """
b AS (SELECT dataset_key, chamber_number, epoch(datetime)::BIGINT // 7200 * 7200 AS t, avg(watersupply) AS watersupply, avg(feedstuff_volume) AS feedstuff_volume FROM readings GROUP BY ALL),
e AS (SELECT dataset_key, chamber_number, unnest(range(lo, hi + 1, 7200)) AS t FROM (SELECT dataset_key, chamber_number, min(t) AS lo, max(t) AS hi FROM b GROUP BY ALL)),
bins AS (SELECT dataset_key, chamber_number, make_timestamp(e.t * 1000000) AS datetime, watersupply, feedstuff_volume FROM e LEFT JOIN b USING (dataset_key, chamber_number, t))"""


def heterogeneous(spark, sf_dir):
    rows = table(spark, sf_dir, "boxes").select("source_video", F.timestamp_seconds(F.col("frame")).cast("timestamp_ntz").alias("datetime"), F.col("x").alias("movement_px"), F.col("w").alias("max_width"), "conf", F.col("track_id").alias("track_count"))
    return rounded(series.resampled(rows, ["source_video"], 600), "movement_px", "max_width", "conf")


def chronological_split(spark, sf_dir):
    rows, _ = series.split_by_time(hourly(spark, sf_dir), KEYS, 0.8, LENGTH, 10)
    return rows.groupBy(*KEYS, "split").agg(F.count("*").alias("rows"), F.min("datetime").alias("first"), F.max("datetime").alias("last"))


def split_summary(spark, sf_dir):
    return series.split_by_time(hourly(spark, sf_dir), KEYS, 0.8, LENGTH, 10)[1]


def ratio_split(spark, sf_dir):
    return series.split_by_ratio(hourly(spark, sf_dir), KEYS, 0.8).groupBy(*KEYS, "split").agg(F.count("*").alias("rows"), F.max("datetime").alias("last"))


def scaling(spark, sf_dir):
    rows = series.split_by_ratio(hourly(spark, sf_dir), KEYS, 0.8)
    fit = series.fit_scaler(rows.where("split = 'train'"), ["watersupply_mean"], KEYS)
    return rounded(series.scale(rows, fit, ["watersupply_mean"], KEYS).select(*KEYS, "datetime", "split", "watersupply_mean"), "watersupply_mean", places=5)


def pooled_scaling(spark, sf_dir):
    rows = series.split_by_ratio(hourly(spark, sf_dir), KEYS, 0.8)
    fit = series.fit_scaler(rows.where("split = 'train'"), ["watersupply_mean"])
    return rounded(series.scale(rows, fit, ["watersupply_mean"]).select(*KEYS, "datetime", "split", "watersupply_mean"), "watersupply_mean", places=5)


SPLIT = HOURLY + """,
r AS (SELECT *, row_number() OVER (PARTITION BY dataset_key, chamber_number ORDER BY datetime) AS i, count(*) OVER (PARTITION BY dataset_key, chamber_number) AS n FROM hourly),
tagged AS (SELECT *, CASE WHEN i <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r)"""
SIZES = HOURLY + """,
s AS (SELECT dataset_key, chamber_number, count(*) AS total_rows FROM hourly GROUP BY ALL),
v AS (SELECT *, least(total_rows, greatest(ceil(total_rows * (1 - 0.8::DOUBLE))::BIGINT, 33)) AS val FROM s),
t AS (SELECT *, total_rows >= 24 + val AS apart, CASE WHEN total_rows >= 24 + val THEN total_rows - val ELSE least(total_rows, greatest(24, floor(total_rows * 0.8::DOUBLE)::BIGINT)) END AS train FROM v)"""


def labelled_windows(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumns({"split": F.when(F.dayofmonth("datetime") % 3 == 0, "b").otherwise("a"), "label": (F.coalesce("watersupply_mean", F.lit(0.0)) > 50).cast("double")})
    return rounded(series.labelled_windows(rows, "label", "split", KEYS, 12), "label_mean")


def sequences(spark, sf_dir):
    """Window matrices, reported by their shape and sum; rows only."""
    rows = quality.imputed(hourly(spark, sf_dir), ["watersupply_mean", "co2_mean"])
    found = series.sequences(rows, ["watersupply_mean", "co2_mean"], KEYS, LENGTH, last=["pig_count"])
    total = F.aggregate(F.flatten("matrix"), F.lit(0.0), lambda a, x: a + x)
    return found.select(*KEYS, "start_datetime", "end_datetime", "end_pig_count", F.size("matrix").alias("rows"), F.round(total + 3e-9, 4).alias("total"))


QUERIES = {
    "flagship_chambers": flagship,
    "agg01_two_level_mean": agg_two_level_mean,
    "win01_rolling_features": rolling,
    "win02_window_table": windows,
    "dom01_rule_evaluation": rule_evaluation,
    "dom02_combined_with_model": combined,
    "dom14_threshold_experiments": experiments,
    "agg35_barn_regression": barn_fit,
    "prj07_implausible_counts": masking,
    "prj10_median_imputation": imputation,
    "prj10_imputation_report": imputation_report,
    "prj06_missing_by_column": missing,
    "agg02_dense_bins": dense,
    "win05_interpolation": interpolation,
    "agg05_heterogeneous_resample": heterogeneous,
    "win10_chronological_split": chronological_split,
    "win10_split_summary": split_summary,
    "win11_ratio_split": ratio_split,
    "win12_group_scaling": scaling,
    "win13_pooled_scaling": pooled_scaling,
    "win04_labelled_windows": labelled_windows,
    "win03_sequences": sequences,
}
W = "WITH "
ORACLE_SQL = {
    "flagship_chambers": oracle(W + WINDOWS.strip() + hits_sql() + COMBINED + """
SELECT 'barn' AS track, dataset_key AS source_dataset, concat(dataset_key, ':', chamber_number) AS chamber_id, count(*) AS windows, round(avg(s), 6) AS mean_score, round(max(s), 6) AS max_score, count_if(a) AS alert_windows,
  count_if(a OR management_rule_score >= 0.6 OR environment_rule_score >= 0.8) AS operational_alert_windows, count_if(s >= 1.5) AS high_tier_windows, false AS low_confidence, CASE WHEN max(s) >= 1.5 THEN 'high' WHEN max(s) >= 0.8 THEN 'medium' ELSE 'normal' END AS chamber_tier
FROM (SELECT *, model_component + disease_rule_score AS s, model_anomaly OR da OR ma OR ea AS a FROM combined) GROUP BY dataset_key, chamber_number"""),
    "agg01_two_level_mean": oracle(W + HOURLY.strip() + """
SELECT dataset_key, chamber_number, datetime, round(feedstuff_volume_mean, 6) AS feedstuff_volume_mean, round(watersupply_mean, 6) AS watersupply_mean, round(barn_temperature_mean, 6) AS barn_temperature_mean, round(co2_mean, 6) AS co2_mean, round(rectal_temperature_mean, 6) AS rectal_temperature_mean,
  round(feedstuff_volume_std, 6) AS feedstuff_volume_std, pig_count, frame_count FROM hourly"""),
    "win01_rolling_features": oracle(W + HOURLY.strip() + """,
r AS (SELECT *, avg(feedstuff_volume_mean) OVER w AS m, stddev_samp(feedstuff_volume_mean) OVER w AS s, lag(feedstuff_volume_mean) OVER o AS l FROM hourly
  WINDOW w AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime RANGE BETWEEN INTERVAL '71 hours 59 minutes' PRECEDING AND CURRENT ROW), o AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime))
SELECT dataset_key, chamber_number, datetime, round(m, 5) AS feedstuff_volume_mean_roll_mean_3d, round(coalesce(s, 0), 5) AS feedstuff_volume_mean_roll_std_3d, round(coalesce((feedstuff_volume_mean - m) / nullif(s, 0), 0), 5) AS feedstuff_volume_mean_zscore_3d, round(coalesce(feedstuff_volume_mean - l, 0), 5) AS feedstuff_volume_mean_delta FROM r"""),
    "win02_window_table": oracle(W + WINDOWS.strip() + " SELECT dataset_key, chamber_number, start_datetime, end_datetime, window_start_index, round(b_mean, 6) AS b_mean, round(b_max, 6) AS b_max, round(b_min, 6) AS b_min FROM full_windows"),
    "dom01_rule_evaluation": oracle(W + WINDOWS.strip() + hits_sql() + " SELECT dataset_key, chamber_number, start_datetime, end_datetime, rule_reasons, k::BIGINT AS rule_triggered_count, rule_score, disease_rule_score, management_rule_score, environment_rule_score, disease_rule_score >= 0.8 OR management_rule_score >= 0.6 OR environment_rule_score >= 0.8 AS rule_anomaly, k > 0 AS rule_observation FROM scored"),
    "dom02_combined_with_model": oracle(W + WINDOWS.strip() + hits_sql() + COMBINED + """
SELECT dataset_key, chamber_number, start_datetime, end_datetime, round(model_component, 6) AS model_component, model_anomaly, round(model_component + disease_rule_score, 6) AS disease_score, CASE WHEN model_component + disease_rule_score >= 1.5 THEN 'high' WHEN model_component + disease_rule_score >= 0.8 THEN 'medium' ELSE 'normal' END AS disease_tier,
  model_anomaly OR da OR ma OR ea AS final_alert, concat_ws(',', CASE WHEN model_anomaly OR da THEN 'disease' END, CASE WHEN ma THEN 'management' END, CASE WHEN ea THEN 'environment' END) AS alert_category,
  concat_ws(' + ', CASE WHEN model_anomaly THEN 'model reconstruction error above threshold' END, CASE WHEN da OR ma OR ea THEN 'rule: ' || concat_ws(' | ', CASE WHEN h1 THEN 'disease: rectal_temp_high' END, CASE WHEN mr <> '' THEN 'management: ' || mr END, CASE WHEN er <> '' THEN 'environment: ' || er END) END) AS primary_reason FROM combined"""),
    "dom14_threshold_experiments": experiment_oracle(),
    "agg35_barn_regression": oracle(W + ROLLED.strip() + " SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(pearson_corr, 6) AS pearson_corr, n_rows FROM fit"),
    "prj07_implausible_counts": oracle(W + HOURLY.strip() + " SELECT 'rectal_temperature_mean' AS feature, count_if(NOT rectal_temperature_mean BETWEEN 35 AND 41.9) AS filtered_rows, count(rectal_temperature_mean) AS total_present_rows FROM hourly UNION ALL SELECT 'barn_temperature_mean', count_if(NOT barn_temperature_mean BETWEEN -10 AND 44), count(barn_temperature_mean) FROM hourly"),
    "prj10_median_imputation": oracle(W + HOURLY.strip() + " SELECT dataset_key, chamber_number, datetime, " + ", ".join(f"round(coalesce({c}_mean, (SELECT quantile_cont({c}_mean, 0.5) FROM hourly), 0), 6) AS {c}_mean" for c in FEATURES) + " FROM hourly"),
    "prj10_imputation_report": oracle(W + HOURLY.strip() + " " + " UNION ALL ".join(f"SELECT '{c}_mean' AS feature, count(*) - count({c}_mean) AS missing, CASE WHEN count({c}_mean) > 0 THEN count(*) - count({c}_mean) ELSE 0 END AS median_filled, CASE WHEN count({c}_mean) = 0 THEN count(*) ELSE 0 END AS zero_filled FROM hourly" for c in FEATURES)),
    "prj06_missing_by_column": oracle(W + HOURLY.strip() + " " + " UNION ALL ".join(f"SELECT '{c}_mean' AS column, round(100.0 * (count(*) - count({c}_mean)) / count(*)::DOUBLE, 6) AS missing_pct FROM hourly" for c in FEATURES)),
    "agg02_dense_bins": oracle(W + DENSE.strip() + " SELECT dataset_key, chamber_number, datetime, round(watersupply, 6) AS watersupply, round(feedstuff_volume, 6) AS feedstuff_volume FROM bins"),
    "win05_interpolation": oracle(W + DENSE.strip() + """,
i AS (SELECT *, row_number() OVER (PARTITION BY dataset_key, chamber_number ORDER BY datetime) AS i FROM bins),
p AS (SELECT *, last_value(watersupply IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN watersupply IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(watersupply IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN watersupply IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM i
  WINDOW b AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT dataset_key, chamber_number, datetime, round(coalesce(watersupply, pv + (nv - pv) / (ni - pi) * (i - pi), pv, nv), 6) AS watersupply FROM p"""),
    "agg05_heterogeneous_resample": oracle("SELECT source_video, make_timestamp((frame // 600 * 600) * 1000000) AS datetime, round(sum(x), 6) AS movement_px, round(max(w), 6) AS max_width, round(avg(conf), 6) AS conf, sum(track_id)::BIGINT AS track_count, count(*) AS frames FROM boxes GROUP BY ALL"),
    "win10_chronological_split": oracle(W + SIZES.strip() + """,
o AS (SELECT *, row_number() OVER (PARTITION BY dataset_key, chamber_number ORDER BY datetime) AS i FROM hourly JOIN t USING (dataset_key, chamber_number) WHERE total_rows >= 24 AND train >= 24 AND val >= 24),
x AS (SELECT *, 'train' AS split FROM o WHERE i <= train UNION ALL SELECT *, 'val' FROM o WHERE i > total_rows - val)
SELECT dataset_key, chamber_number, split, count(*) AS rows, min(datetime) AS first, max(datetime) AS last FROM x GROUP BY ALL"""),
    "win10_split_summary": oracle(W + SIZES.strip() + """
SELECT dataset_key, chamber_number, total_rows, CASE WHEN total_rows < 24 THEN 0 ELSE train END AS train_rows, CASE WHEN total_rows < 24 THEN 0 ELSE val END AS val_rows, CASE WHEN total_rows < 24 THEN 0 ELSE greatest(0, train - 23) END AS train_windows, CASE WHEN total_rows < 24 THEN 0 ELSE greatest(0, val - 23) END AS val_windows,
  CASE WHEN total_rows < 24 OR apart THEN 0 ELSE greatest(0, train + val - total_rows) END AS overlap_rows, CASE WHEN total_rows < 24 THEN 'skipped_too_short' WHEN train < 24 OR val < 24 THEN 'skipped_no_windows' WHEN apart THEN 'non_overlapping' ELSE 'overlap_for_short_group' END AS status FROM t"""),
    "win11_ratio_split": oracle(W + SPLIT.strip() + " SELECT dataset_key, chamber_number, split, count(*) AS rows, max(datetime) AS last FROM tagged GROUP BY ALL"),
    "win12_group_scaling": oracle(W + SPLIT.strip() + ", f AS (SELECT dataset_key, chamber_number, avg(watersupply_mean) AS m, coalesce(nullif(stddev_pop(watersupply_mean), 0), 1) AS s FROM tagged WHERE split = 'train' GROUP BY ALL) SELECT dataset_key, chamber_number, datetime, split, round((watersupply_mean - m) / s, 5) AS watersupply_mean FROM tagged JOIN f USING (dataset_key, chamber_number)"),
    "win13_pooled_scaling": oracle(W + SPLIT.strip() + ", f AS (SELECT avg(watersupply_mean) AS m, coalesce(nullif(stddev_pop(watersupply_mean), 0), 1) AS s FROM tagged WHERE split = 'train') SELECT dataset_key, chamber_number, datetime, split, round((watersupply_mean - m) / s, 5) AS watersupply_mean FROM tagged, f"),
    "win03_sequences": oracle(W + HOURLY.strip() + """,
f AS (SELECT *, coalesce(watersupply_mean, (SELECT quantile_cont(watersupply_mean, 0.5) FROM hourly), 0) + coalesce(co2_mean, (SELECT quantile_cont(co2_mean, 0.5) FROM hourly), 0) AS s FROM hourly),
w AS (SELECT dataset_key, chamber_number, datetime AS start_datetime, lead(datetime, 23) OVER o AS end_datetime, lead(pig_count, 23) OVER o AS end_pig_count, sum(s) OVER a AS total, count(*) OVER a AS rows FROM f
  WINDOW o AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime), a AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING))
SELECT dataset_key, chamber_number, start_datetime, end_datetime, end_pig_count, rows::INT AS rows, round(total, 4) AS total FROM w WHERE rows = 24"""),
    "win04_labelled_windows": oracle(W + HOURLY.strip() + """,
l AS (SELECT *, (day(datetime) % 3 = 0)::INT AS b, (coalesce(watersupply_mean, 0) > 50)::INT::DOUBLE AS label FROM hourly),
w AS (SELECT dataset_key, chamber_number, datetime AS start_datetime, lead(datetime, 11) OVER o AS end_datetime, sum(b) OVER a AS nb, avg(label) OVER a AS label_mean, max(label) OVER a AS label_max, count(*) OVER a AS rows FROM l
  WINDOW o AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime), a AS (PARTITION BY dataset_key, chamber_number ORDER BY datetime ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
SELECT dataset_key, chamber_number, start_datetime, end_datetime, CASE WHEN nb > 6 THEN 'b' ELSE 'a' END AS window_split, round(label_mean, 6) AS label_mean, label_max, rows FROM w WHERE rows = 12"""),
}
