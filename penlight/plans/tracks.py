"""Queries of the vision, cohort, review and model tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from penlight.operators import evaluate, models, review, vision
from penlight.sources.adapters import oracle, rounded, table

LABELS = ("walking", "feeding", "lying", "sitting", "standing")
FRAME = ["facility", "pen", "frame_id", "datetime"]
RULES = [("rectal_temp_high", "disease"), ("neck_temp_high", "disease"), ("feed_drop", "management"), ("co2_high", "environment"), ("nh3_high", "environment"), ("water_drop", "management"), ("never_used", "disease")]
BODY = ("walking", "running", "feeding", "drinking")


def frames(spark, sf_dir):
    return vision.frame_activity(table(spark, sf_dir, "points"), FRAME, LABELS)


def frame_activity(spark, sf_dir):
    names = ["center_x_mean", "center_y_std", "span_x_mean", "active_ratio", "rest_ratio", "lying_ratio"]
    return rounded(frames(spark, sf_dir).select(*FRAME, "annotations", "points", *names, "max_span_y", "feeding_count", "active_count", "rest_count"), *names, places=5)


def behaviour_series(spark, sf_dir):
    return rounded(vision.behaviour_series(frames(spark, sf_dir), ["facility"], LABELS[:3]), "walking_ratio", "feeding_ratio", "lying_ratio")


def posture_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "points").withColumns({"bin": F.col("datetime").cast("date"), "condition": F.when(F.col("span_y") > 25, "hot").otherwise("cool")})
    return rounded(vision.posture_shares(rows, ["facility"], "label", LABELS[:2], ["datetime", "frame_id", "point_count", "span_y", "center_y", "span_x", "pen"], ["center_x"], "condition", "bin"), "walking_share", "feeding_share", "change_rate", "center_x")


def motion_of(spark, sf_dir):
    return vision.track_motion(vision.box_geometry(table(spark, sf_dir, "boxes")))


def motion(spark, sf_dir):
    names = ["movement", "movement_per_frame", "movement_norm", "speed"]
    return rounded(motion_of(spark, sf_dir).select("source_video", "track_id", "frame", "frame_gap", *names), *names, places=4).withColumn("frame_gap", F.col("frame_gap").cast("double"))


def track_summary(spark, sf_dir):
    names = ["coverage", "mean_conf", "movement_total", "movement_mean", "movement_p95", "low_ratio", "high_ratio"]
    return rounded(vision.track_summary(motion_of(spark, sf_dir)), *names, places=4)


def frame_summary(spark, sf_dir):
    names = ["mean_conf", "movement_total", "movement_mean", "max_movement", "area_mean", "center_x_mean", "center_x_std"]
    return rounded(vision.frame_summary(motion_of(spark, sf_dir)), *names, places=4)


def pen_summary(spark, sf_dir):
    m = motion_of(spark, sf_dir)
    return rounded(vision.pen_summary(vision.frame_summary(m), vision.track_summary(m)), "mean_tracks", "movement_total", "mean_coverage", "mean_low_ratio", places=3)


def activity_form(spark, sf_dir):
    rows = vision.activity_form(vision.frame_summary(motion_of(spark, sf_dir)))
    return rounded(rows, "center_x_mean", "span_x_mean", "span_y_mean", places=4)


def yolo(spark, sf_dir):
    classes = spark.createDataFrame([("v0", 0), ("v1", 1), ("v2", 2)], "label string, class_id int")
    rows = vision.yolo_labels(vision.box_geometry(table(spark, sf_dir, "boxes")).withColumnRenamed("source_video", "label"), classes)
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.count("class_id").alias("known"), F.avg("cx").alias("cx"), F.max("bh").alias("bh")), "cx", "bh")


def paired(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.concat(F.lit("img/"), F.col("o_orderkey").cast("string")).alias("path"), F.concat_ws("/", (F.col("o_orderkey") % 10).cast("string"), F.col("o_custkey").cast("string")).alias("stem"))
    right = table(spark, sf_dir, "customer").select(F.concat(F.lit("lab/"), F.col("c_custkey").cast("string")).alias("path"), F.concat_ws("/", (F.col("c_custkey") % 10).cast("string"), F.col("c_custkey").cast("string")).alias("stem")).where("c_custkey % 3 > 0")
    return vision.paired_paths(left, right).groupBy("matched_by").agg(F.count("*").alias("n"))


def profiles(spark, sf_dir):
    rows = table(spark, sf_dir, "points")
    return vision.profile(rows, [[], ["facility"], ["label"], ["facility", "label"]], {"frames": F.count_distinct("frame_id")}).withColumn("facility", F.col("facility").cast("double"))


def window_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("animal"), (F.col("l_suppkey") % 20).alias("window"), F.col("l_quantity").alias("ax"), (F.col("l_discount") * 100).alias("ay"), (F.col("l_tax") * 100).alias("az"), F.col("l_returnflag").alias("behaviour"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    found = vision.window_features(rows, ["animal", "window"], ["ax", "ay", "az"], "behaviour", F.struct("seq", "behaviour"))
    names = ["ax_mean", "ay_std", "az_max", "magnitude_mean", "magnitude_std", "magnitude_min"]
    return rounded(found.select("animal", "window", *names, "label", "rows"), *names, places=5)


def animal_days(spark, sf_dir):
    rows = vision.animal_days(vision.animal_hours(table(spark, sf_dir, "activity")))
    return rounded(rows, "total", "mean", "std", "night_share", places=4)


def day_changes(spark, sf_dir):
    from penlight.operators.series import drop_features

    days = vision.animal_days(vision.animal_hours(table(spark, sf_dir, "activity"))).select("pig_id", "day", "total")
    return rounded(drop_features(days, "total", ["pig_id"], "day"), "total", "total_change", "total_zscore", places=4)


def challenge(spark, sf_dir):
    rows = table(spark, sf_dir, "challenge")
    key = ["pig_id", "day"]
    treated = rows.where("pig_id % 7 = 0 and day > 9").select(*key)
    return vision.challenge_days(rows.where("day % 2 = 0").select(*key, "rectal_temperature"), rows.where("pig_id % 3 > 0").select(*key, "clinical"), rows.where("day > 4").select(*key, "viral"), treated)


def challenge_days(spark, sf_dir):
    return rounded(challenge(spark, sf_dir), "rectal_temperature").withColumns({"clinical": F.col("clinical").cast("double"), "viral": F.col("viral").cast("double")})


def daily_cohort(spark, sf_dir):
    return rounded(vision.daily_cohort(challenge(spark, sf_dir), 41.01), "mean_temperature", "max_temperature")


def animal_timeline(spark, sf_dir):
    return rounded(vision.animal_timeline(challenge(spark, sf_dir), 41.01), "max_temperature")


CHALLENGE = """
d AS (SELECT pig_id, day, CASE WHEN day % 2 = 0 THEN rectal_temperature END AS rectal_temperature, CASE WHEN pig_id % 3 > 0 THEN clinical END AS clinical, CASE WHEN day > 4 THEN viral END AS viral, pig_id % 7 = 0 AND day > 9 AS treated FROM challenge WHERE day % 2 = 0 OR pig_id % 3 > 0 OR day > 4),
c AS (SELECT *, coalesce(clinical > 0, false) AS symptomatic, coalesce(viral > 0, false) AS viral_positive FROM d)"""


def wide(spark, sf_dir):
    rows = table(spark, sf_dir, "challenge")
    # At most 200 pigs: the view takes their ids modulo 200.
    pigs = [r.pig_id for r in rows.select("pig_id").distinct().orderBy("pig_id").collect()]
    return rounded(vision.long_form(rows.groupBy("day").pivot("pig_id", pigs).agg(F.max("rectal_temperature")), "day", "temperature"), "temperature")


def review_summary(spark, sf_dir):
    return rounded(review.summary(table(spark, sf_dir, "reviews")), "precision_estimate")


def rule_feedback(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule_id string, category string")
    return rounded(review.rule_feedback(table(spark, sf_dir, "reviews"), rules), "false_alarm_rate", "confirmed_rate")


def incident_rows(spark, sf_dir):
    return table(spark, sf_dir, "reviews").select("incident_id", "queue", "reason")


def log_of(spark, sf_dir):
    number = F.substring("incident_id", 10, 19).cast("long") % 3
    some = incident_rows(spark, sf_dir).where(number > 0)
    return review.template(some, ["incident_id", "queue", "reason"]).withColumn("review_status", F.when(number == 1, "confirmed").otherwise("pending"))


def merged_log(spark, sf_dir):
    new = incident_rows(spark, sf_dir).where("queue <> 'disease'")
    return review.merged(log_of(spark, sf_dir), new, ["incident_id", "queue", "reason"]).groupBy("queue", "review_status").agg(F.count("*").alias("n"))


def decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.concat(F.lit("incident-"), (F.col("o_orderkey") - F.col("o_orderkey") % 2).cast("string")).alias("incident_id"), F.when(F.col("o_custkey") % 5 == 0, "later").when(F.col("o_custkey") % 5 < 3, " Confirmed").otherwise("dismissed").alias("decision"), F.col("o_orderdate").cast("string").alias("resolved_at"), F.lit("").alias("reviewed_by"), F.col("o_orderkey").alias("sequence"))


def decided_log(spark, sf_dir):
    found = review.decided(review.template(incident_rows(spark, sf_dir), ["incident_id", "queue", "reason"]), decisions(spark, sf_dir))
    return found.groupBy("review_status", "confirmed", "false_alarm", "reviewed_by").agg(F.count("*").alias("n"))


def skipped_decisions(spark, sf_dir):
    return review.skipped(log_of(spark, sf_dir), decisions(spark, sf_dir)).groupBy("decision").agg(F.count("*").alias("n"))


def scored_windows(spark, sf_dir):
    return rounded(table(spark, sf_dir, "scored_windows"), "error", places=7)


def percentile_thresholds(spark, sf_dir):
    found = evaluate.percentile_thresholds(scored_windows(spark, sf_dir), [90.0, 95.0, 99.0], ["pig"], ["seq"], 2)
    return rounded(found, "threshold", "min_error", "median_error", "mean_error", "max_error", places=5)


def detection(spark, sf_dir):
    rows = evaluate.detected(scored_windows(spark, sf_dir), F.col("split") == "val", 90.0, ["split", "pig"], ["seq"], 2)
    return rounded(evaluate.detection_summary(rows, ["split"]), "mean_error", "raw_rate", "confirmed_rate", places=5)


def histogram(spark, sf_dir):
    return evaluate.histogram(scored_windows(spark, sf_dir), 12)


def bootstrap(spark, sf_dir):
    return evaluate.bootstrap_percentile(scored_windows(spark, sf_dir).where("split = 'val'"), 95.0)


def windows64(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def reconstruction_of(spark, sf_dir):
    rows = windows64(spark, sf_dir)
    return models.reconstruction(rows.where("vec_id % 4 > 0"), rows, "v")


def reconstruction(spark, sf_dir):
    return reconstruction_of(spark, sf_dir).select("vec_id", F.round("error", 6).alias("error"))


def top_features(spark, sf_dir):
    return models.top_features(reconstruction_of(spark, sf_dir), ["vec_id"], [f"f{i}" for i in range(8)]).withColumn("error", F.round("error", 6))


def worst_features(spark, sf_dir):
    return models.worst_window_features(reconstruction_of(spark, sf_dir), ["vec_id"])


def window_map(spark, sf_dir):
    return models.window_map(windows64(spark, sf_dir), "v", ["vec_id"])[0]


def isolation(spark, sf_dir):
    rows = windows64(spark, sf_dir)
    return models.isolation_scores(rows.where("vec_id % 4 > 0"), rows, "v", "vec_id").select("vec_id", "score", "outlier")


def forest(spark, sf_dir):
    rows = windows64(spark, sf_dir).select("vec_id", F.concat(F.lit("k"), (F.col("label") % 3).cast("string")).alias("kind"), (F.col("vec_id") % 20).alias("clip"), *[F.element_at("v", i + 1).alias(f"x{i}") for i in range(8)])
    return models.macro_f1(models.forest_confusion(models.group_hold_out(rows, "clip"), [f"x{i}" for i in range(8)], "kind", "vec_id"))


def hold_out(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("clip"))
    return models.group_hold_out(rows, "clip").groupBy("split").agg(F.count_distinct("clip").alias("clips"))


QUERIES = {
    "ml06_hold_out": hold_out,
    "agg03_frame_activity": frame_activity, "agg07_behaviour_series": behaviour_series, "agg09_posture_shares": posture_shares, "win07_track_motion": motion, "agg19_track_summary": track_summary, "agg20_frame_summary": frame_summary, "agg21_pen_summary": pen_summary,
    "prj31_activity_form": activity_form, "prj23_yolo_labels": yolo, "join14_paired_paths": paired, "agg25_profiles": profiles, "agg18_window_features": window_features, "agg16_animal_days": animal_days, "win08_day_changes": day_changes,
    "join04_challenge_days": challenge_days, "agg30_daily_cohort": daily_cohort, "win20_animal_timeline": animal_timeline, "src09_long_form": wide, "agg26_review_summary": review_summary, "dom17_rule_feedback": rule_feedback, "rev02_merged_log": merged_log,
    "rev03_decided_log": decided_log, "rev03_skipped": skipped_decisions, "evl09_percentile_thresholds": percentile_thresholds, "ml02_detection": detection, "agg36_histogram": histogram, "evl10_bootstrap": bootstrap,
    "ml01_reconstruction": reconstruction, "top03_window_features": top_features, "top03_worst_features": worst_features, "ml04_window_map": window_map, "ml03_isolation": isolation, "ml05_forest": forest,
}
MOTION = """
g AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy, w * h AS area, sqrt(1280.0 * 1280 + 720 * 720) AS diagonal FROM boxes),
l AS (SELECT *, frame - lag(frame) OVER o AS frame_gap, sqrt((cx - lag(cx) OVER o) ** 2 + (cy - lag(cy) OVER o) ** 2) AS step FROM g WINDOW o AS (PARTITION BY source_video, track_id ORDER BY frame)),
m AS (SELECT *, step AS movement, step / frame_gap AS pf FROM l),
t AS (SELECT source_video, pen_id, track_id, max(frame) - min(frame) + 1 AS span_frames, count(DISTINCT frame) AS observed_frames, avg(conf) AS c, sum(movement) AS mt, avg(movement) AS mm, quantile_cont(movement, 0.95) AS p95, avg((pf < 5)::INT) AS lr, avg((pf > 40)::INT) AS hr FROM m GROUP BY ALL),
f AS (SELECT source_video, pen_id, frame, count(DISTINCT track_id) AS tracks, avg(conf) AS c, sum(movement) AS mt, avg(movement) AS mm, max(movement) AS mx, avg(area) AS a, avg(cx) AS x, coalesce(stddev_samp(cx), 0) AS s FROM m GROUP BY ALL)"""
OUT = "(CASE WHEN confirmed IN ('true') OR review_status = 'confirmed' THEN true ELSE false END) AS y, (CASE WHEN trim(lower(false_alarm)) = 'yes' OR review_status = 'false_alarm' THEN true ELSE false END) AS n"
WINDOWS = "v AS (SELECT split, pig, seq, round(error, 7) AS error FROM scored_windows)"


def confirmed(keys: str, source: str, flag: str) -> str:
    return f"i AS (SELECT *, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM {source}), k AS (SELECT *, {flag} AND count(CASE WHEN {flag} THEN 1 END) OVER (PARTITION BY {keys}, g) >= 2 AS confirmed FROM i)"


ORACLE_SQL = {
    "ml06_hold_out": "WITH g AS (SELECT count(DISTINCT vec_id % 20) AS n FROM embeddings) SELECT 'val' AS split, greatest(1, n // 5) AS clips FROM g UNION ALL SELECT 'train', n - greatest(1, n // 5) FROM g",
    "agg03_frame_activity": oracle("""
WITH c AS (SELECT facility, pen, frame_id, datetime, count(*) AS annotations, sum(point_count)::BIGINT AS points, avg(center_x) AS x, stddev_pop(center_y) AS y, avg(span_x) AS s, max(span_y) AS max_span_y, count_if(label = 'feeding') AS feeding_count, count_if(label = 'lying') AS l, count_if(label IN ('walking', 'feeding')) AS active_count, count_if(label IN ('sitting', 'lying')) AS rest_count FROM points GROUP BY ALL)
SELECT facility, pen, frame_id, datetime, annotations, points, round(x, 5) AS center_x_mean, round(y, 5) AS center_y_std, round(s, 5) AS span_x_mean, round(active_count / annotations::DOUBLE, 5) AS active_ratio, round(rest_count / annotations::DOUBLE, 5) AS rest_ratio, round(l / annotations::DOUBLE, 5) AS lying_ratio, max_span_y, feeding_count, active_count, rest_count FROM c"""),
    "agg07_behaviour_series": oracle("SELECT facility, make_timestamp(epoch(datetime)::BIGINT // 600 * 600 * 1000000) AS datetime, count(*) AS annotations, count(DISTINCT (pen, frame_id, datetime)) AS frames, " + ", ".join(f"count_if(label = '{x}') AS {x}_count, round(count_if(label = '{x}') / count(*)::DOUBLE, 6) AS {x}_ratio" for x in LABELS[:3]) + " FROM points GROUP BY 1, 2"),
    "agg09_posture_shares": oracle("""
WITH l AS (SELECT *, datetime::DATE AS bin, span_y > 25 AS hot, coalesce((label <> lag(label) OVER (PARTITION BY facility ORDER BY datetime, frame_id, point_count, span_y, center_y, span_x, pen))::INT, 0) AS c FROM points)
SELECT facility, bin, round(avg((label = 'walking')::INT), 6) AS walking_share, round(avg((label = 'feeding')::INT), 6) AS feeding_share, round(avg(c), 6) AS change_rate, round(avg(center_x), 6) AS center_x, CASE WHEN 2 * count_if(hot) > count(*) THEN 'hot' ELSE 'cool' END AS condition, count(*) AS rows FROM l GROUP BY 1, 2"""),
    "win07_track_motion": oracle("WITH " + MOTION.strip() + " SELECT source_video, track_id, frame, frame_gap::DOUBLE AS frame_gap, round(movement, 4) AS movement, round(pf, 4) AS movement_per_frame, round(movement / diagonal, 4) AS movement_norm, round(pf * 30, 4) AS speed FROM m"),
    "agg19_track_summary": oracle("WITH " + MOTION.strip() + " SELECT source_video, pen_id, track_id, span_frames, observed_frames, round(observed_frames / span_frames::DOUBLE, 4) AS coverage, round(c, 4) AS mean_conf, round(mt, 4) AS movement_total, round(mm, 4) AS movement_mean, round(p95, 4) AS movement_p95, round(lr, 4) AS low_ratio, round(hr, 4) AS high_ratio FROM t"),
    "agg20_frame_summary": oracle("WITH " + MOTION.strip() + " SELECT source_video, pen_id, frame, tracks, round(c, 4) AS mean_conf, round(mt, 4) AS movement_total, round(mm, 4) AS movement_mean, round(mx, 4) AS max_movement, round(a, 4) AS area_mean, round(x, 4) AS center_x_mean, round(s, 4) AS center_x_std FROM f"),
    "agg21_pen_summary": oracle("WITH " + MOTION.strip() + ", a AS (SELECT source_video, pen_id, count(*) AS frames, avg(tracks) AS mt, sum(mt) AS mv FROM f GROUP BY ALL), b AS (SELECT source_video, pen_id, count(*) AS tracks, avg(observed_frames / span_frames::DOUBLE) AS mc, avg(lr) AS ml FROM t GROUP BY ALL) SELECT source_video, pen_id, frames, round(mt, 3) AS mean_tracks, round(mv, 3) AS movement_total, tracks, round(mc, 3) AS mean_coverage, round(ml, 3) AS mean_low_ratio FROM a LEFT JOIN b USING (source_video, pen_id)"),
    "prj31_activity_form": oracle("WITH " + MOTION.strip() + " SELECT substring(pen_id, 2)::BIGINT AS pen, TIMESTAMP '2000-01-01' + to_seconds(frame) AS datetime, tracks AS annotations, round(x, 4) AS center_x_mean, round(sqrt(a), 4) AS span_x_mean, round(sqrt(a), 4) AS span_y_mean FROM f"),
    "prj23_yolo_labels": oracle("SELECT source_video AS label, count(*) AS n, CASE WHEN source_video IN ('v0', 'v1', 'v2') THEN count(*) ELSE 0 END AS known, round(avg((x + w / 2) / 1280), 6) AS cx, round(max(h / 720), 6) AS bh FROM boxes GROUP BY 1"),
    "join14_paired_paths": "SELECT CASE WHEN c_custkey IS NULL THEN 'none' WHEN o_orderkey % 10 = o_custkey % 10 THEN 'stem' ELSE 'base' END AS matched_by, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0 GROUP BY 1",
    "agg25_profiles": oracle("SELECT facility::DOUBLE AS facility, label, count(*) AS n, count(DISTINCT frame_id) AS frames, grouping_id(facility, label)::BIGINT AS grouping FROM points GROUP BY GROUPING SETS ((), (facility), (label), (facility, label))"),
    "agg18_window_features": "WITH r AS (SELECT l_partkey % 50 AS animal, l_suppkey % 20 AS w, l_quantity AS ax, l_discount * 100 AS ay, l_tax * 100 AS az, sqrt(l_quantity ** 2 + (l_discount * 100) ** 2 + (l_tax * 100) ** 2) AS m, l_returnflag AS b, (l_orderkey * 10 + l_linenumber, l_returnflag) AS s FROM lineitem) SELECT animal, w AS window, round(avg(ax) + 3e-9, 5) AS ax_mean, round(stddev_samp(ay) + 3e-9, 5) AS ay_std, round(max(az) + 3e-9, 5) AS az_max, round(avg(m) + 3e-9, 5) AS magnitude_mean, round(stddev_samp(m) + 3e-9, 5) AS magnitude_std, round(min(m) + 3e-9, 5) AS magnitude_min, arg_min(b, s) AS label, count(*) AS rows FROM r GROUP BY 1, 2",
    "agg16_animal_days": oracle("WITH h AS (SELECT pig_id, day, hour, sum(movement) AS v FROM activity GROUP BY ALL) SELECT pig_id, day, round(sum(v), 4) AS total, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, count(*) AS hours, round(sum(CASE WHEN hour IN (22, 23, 0, 1, 2, 3, 4, 5) THEN v ELSE 0 END) / sum(v), 4) AS night_share, count(*) < 20 AS low_data FROM h GROUP BY ALL"),
    "win08_day_changes": oracle("WITH h AS (SELECT pig_id, day, sum(movement) AS t FROM activity GROUP BY ALL) SELECT pig_id, day, round(t, 4) AS total, round(t / nullif(lag(t) OVER (PARTITION BY pig_id ORDER BY day), 0) - 1, 4) AS total_change, round((t - avg(t) OVER (PARTITION BY pig_id)) / nullif(stddev_samp(t) OVER (PARTITION BY pig_id), 0), 4) AS total_zscore FROM h"),
    "join04_challenge_days": oracle("WITH " + CHALLENGE.strip() + " SELECT pig_id, day, round(rectal_temperature, 6) AS rectal_temperature, clinical::DOUBLE AS clinical, viral::DOUBLE AS viral, treated, symptomatic, viral_positive FROM c"),
    "agg30_daily_cohort": oracle("WITH " + CHALLENGE.strip() + " SELECT day, count(DISTINCT pig_id) AS pigs, count_if(symptomatic) AS symptomatic, count_if(rectal_temperature >= 41.01) AS rule_positive, count_if(viral_positive) AS viral_positive, round(avg(rectal_temperature), 6) AS mean_temperature, round(max(rectal_temperature), 6) AS max_temperature FROM c GROUP BY 1"),
    "win20_animal_timeline": oracle("WITH " + CHALLENGE.strip() + ", t AS (SELECT pig_id, min(CASE WHEN symptomatic THEN day END)::DOUBLE AS s, min(CASE WHEN rectal_temperature >= 41.01 THEN day END)::DOUBLE AS r, min(CASE WHEN viral_positive THEN day END)::DOUBLE AS v, max(rectal_temperature) AS m, count(*) AS days FROM c GROUP BY 1) SELECT pig_id, s AS first_symptom, r AS first_rule, v AS first_virus, r - s AS rule_lag, round(m, 6) AS max_temperature, days FROM t"),
    "src09_long_form": oracle("SELECT day, pig_id::VARCHAR AS pig_id, round(rectal_temperature, 6) AS temperature FROM challenge"),
    "agg26_review_summary": oracle(f"WITH r AS (SELECT *, {OUT} FROM reviews) SELECT coalesce(queue, 'all') AS scope, count(*) AS incidents, count_if(review_status <> 'pending') AS reviewed, count_if(review_status = 'pending') AS pending, count_if(y) AS confirmed, count_if(n) AS false_alarm, count_if(review_status = 'needs_data') AS needs_data, round(count_if(y) / count_if(y OR n)::DOUBLE, 6) AS precision_estimate, count_if(followup_required = 'y') AS followup_required FROM r GROUP BY ROLLUP (queue)"),
    "dom17_rule_feedback": oracle(f"""
WITH u AS (SELECT * FROM (VALUES {', '.join(map(str, RULES))}) t(rule_id, category)), r AS (SELECT *, {OUT} FROM reviews),
g AS (SELECT u.rule_id, u.category, count(DISTINCT incident_id) AS incidents, count_if(review_status <> 'pending') AS reviewed, count_if(y) AS confirmed, count_if(n) AS false_alarm, count_if(review_status = 'needs_data') AS needs_data FROM u LEFT JOIN r ON r.queue = u.category AND list_contains(regexp_split_to_array(reason, '[^A-Za-z0-9_]+'), u.rule_id) GROUP BY ALL),
x AS (SELECT *, false_alarm / nullif(confirmed + false_alarm, 0)::DOUBLE AS w, confirmed / nullif(confirmed + false_alarm, 0)::DOUBLE AS c FROM g)
SELECT rule_id, category, incidents, reviewed, confirmed, false_alarm, needs_data, round(w, 6) AS false_alarm_rate, round(c, 6) AS confirmed_rate, CASE WHEN reviewed < 3 THEN 'collect_more_reviews' WHEN w >= 0.6 THEN 'tighten_threshold' WHEN c >= 0.8 THEN 'keep_or_relax_carefully' WHEN needs_data > 0 THEN 'improve_data_capture' ELSE 'monitor' END AS recommendation FROM x"""),
    "evl09_percentile_thresholds": oracle(f"WITH {WINDOWS}, c AS (SELECT unnest([90.0, 95.0, 99.0])::DOUBLE AS percentile, unnest(quantile_cont(error, [0.9, 0.95, 0.99])) AS threshold FROM v), r AS (SELECT *, error > threshold AS raw FROM v, c), {confirmed('percentile, pig', 'r', 'raw')} SELECT percentile, round(threshold, 5) AS threshold, count(*) AS windows, count_if(raw) AS raw, count_if(confirmed) AS confirmed, round(min(error), 5) AS min_error, round(quantile_cont(error, 0.5), 5) AS median_error, round(avg(error), 5) AS mean_error, round(max(error), 5) AS max_error FROM k GROUP BY percentile, k.threshold"),
    "ml02_detection": oracle(f"WITH {WINDOWS}, r AS (SELECT *, error > (SELECT quantile_cont(error, 0.9) FROM v WHERE split = 'val') AS raw FROM v), {confirmed('split, pig', 'r', 'raw')} SELECT split, count(*) AS windows, round(avg(error), 5) AS mean_error, count_if(raw) AS raw, count_if(confirmed) AS confirmed, round(avg(raw::INT), 5) AS raw_rate, round(avg(confirmed::INT), 5) AS confirmed_rate FROM k GROUP BY 1"),
    "rev02_merged_log": oracle("WITH i AS (SELECT *, substring(incident_id, 10)::BIGINT % 3 AS m FROM reviews WHERE queue <> 'disease' OR substring(incident_id, 10)::BIGINT % 3 > 0) SELECT queue, CASE WHEN m = 1 THEN 'confirmed' ELSE 'pending' END AS review_status, count(*) AS n FROM i GROUP BY ALL"),
    "rev03_decided_log": oracle("WITH d AS (SELECT concat('incident-', o_orderkey - o_orderkey % 2) AS id, arg_max(o_custkey % 5 < 3, o_orderkey) AS yes FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1) SELECT CASE WHEN yes IS NULL THEN 'pending' WHEN yes THEN 'confirmed' ELSE 'false_alarm' END AS review_status, yes AS confirmed, NOT yes AS false_alarm, CASE WHEN yes IS NULL THEN '' ELSE 'dashboard_operator' END AS reviewed_by, count(*) AS n FROM reviews LEFT JOIN d ON id = incident_id GROUP BY ALL"),
    "rev03_skipped": "SELECT CASE WHEN o_custkey % 5 = 0 THEN 'later' WHEN o_custkey % 5 < 3 THEN ' Confirmed' ELSE 'dismissed' END AS decision, count(*) AS n FROM orders WHERE o_orderkey - o_orderkey % 2 NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 > 0) GROUP BY 1",
    "agg36_histogram": oracle(f"WITH {WINDOWS} SELECT least(floor((error - (SELECT min(error) FROM v)) / ((SELECT max(error) FROM v) - (SELECT min(error) FROM v)) * 12), 11)::BIGINT AS bin, count(*) AS n FROM v GROUP BY 1"),
}
