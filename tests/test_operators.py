"""Operators on small frames with known results, and randomized checks against plain Python."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from penlight.operators import alerts, compare, evaluate, events, models, penday, quality, rules, series, vision

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_rules_score_bonus_and_null(spark):
    windows = spark.createDataFrame([(1, 40.0, -2.0, float("nan")), (2, None, -2.0, 5.0), (3, 30.0, 0.0, 0.0)], "k int, t__wmax double, f__wmean double, c__wmax double")
    rule = lambda i, f, agg, op, t, s, c: {"id": i, "feature": f, "agg": agg, "op": op, "threshold": t, "severity": s, "category": c}
    some = [rule("fever", "t", "max", ">=", 39.5, "high", "disease"), rule("feed", "f", "mean", "<=", -1.5, "medium", "management"), rule("gas", "c", "max", ">=", 4, "odd", "odd"), {"id": "both", "severity": "low", "category": "disease", "all_of": [{"feature": "t", "agg": "max", "op": ">=", "threshold": 39}, {"feature": "f", "agg": "mean", "op": "<=", "threshold": -1}]}]
    rows = {r.k: r for r in rules.evaluate(windows, some, ["k"]).collect()}
    assert rows[1].rule_reasons == "fever,feed,both" and rows[1].rule_score == pytest.approx(1.0 + 0.6 + 0.3 + 0.6)
    assert rows[1].disease_rule_score == pytest.approx(1.6) and rows[1].rule_anomaly
    # An unknown category counts as disease, an unknown severity as medium.
    assert rows[2].rule_reasons == "feed,gas" and rows[2].disease_rule_score == pytest.approx(0.6) and not rows[2].disease_rule_anomaly
    assert rows[3].rule_reasons == "" and not rows[3].rule_observation
    with pytest.raises(KeyError):
        rules.evaluate(windows, [rule("x", "nope", "max", ">=", 1, "low", "disease")], ["k"])
    with pytest.raises(ValueError):
        rules.evaluate(windows, [rule("x", "t", "max", ">", 1, "low", "disease")], ["k"])
    assert rules.override(some, rules.parsed_overrides("fever=41"))[0]["threshold"] == 41.0
    with pytest.raises(KeyError):
        rules.override(some, {"none": 1.0})


def test_model_share_is_capped_and_absent_is_zero(spark):
    table = spark.createDataFrame([(1, 0.0, 0.0, 0.0, False, False, False, False, "", "", ""), (2, 1.0, 0.0, 0.0, True, False, False, True, "fever", "", "")], "k int, disease_rule_score double, management_rule_score double, environment_rule_score double, disease_rule_anomaly boolean, management_rule_anomaly boolean, environment_rule_anomaly boolean, rule_anomaly boolean, disease_rule_reasons string, management_rule_reasons string, environment_rule_reasons string")
    seen = spark.createDataFrame([(2, 9.0, 1.0, True)], "k int, reconstruction_error double, threshold double, confirmed_anomaly boolean")
    rows = {r.k: r for r in rules.combine(table, seen, ["k"]).collect()}
    assert (rows[1].model_component, rows[1].disease_tier, rows[1].alert_category, rows[1].primary_reason) == (0.0, "normal", "", "")
    assert (rows[2].model_component, rows[2].disease_score, rows[2].disease_tier) == (1.0, 2.0, "high")


def test_runs_match_plain_python(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.random() < 0.6 if rng.random() < 0.9 else None) for g in "abc" for i in range(60)]
    found = {(r.g, r.i) for r in series.confirm_runs(spark.createDataFrame(rows, "g string, i int, on boolean"), "on", ["g"], ["i"], 3).where("confirmed").collect()}
    expected = set()
    for g in "abc":
        run = []
        for i in [*range(60), None]:
            on = i is not None and next(x for a, b, x in rows if (a, b) == (g, i))
            if on:
                run.append((g, i))
            else:
                expected |= set(run) if len(run) >= 3 else set()
                run = []
    assert found == expected


def test_incidents_match_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for c in ("c1", "c2"):
        for _ in range(60):
            a = rng.randrange(400)
            start, end = None if rng.random() < 0.05 else hours(a), None if rng.random() < 0.05 else hours(a + rng.choice([1, 5, 30]))
            rows.append(("disease", c, "r", start, end, 1, "urgent", "t", "d", 1.0, 0.0, 0.0, "high", "do"))
    schema = "queue string, chamber_id string, reason string, start_datetime timestamp_ntz, end_datetime timestamp_ntz, priority_rank int, priority string, track string, source_dataset string, track_score double, management_score double, environment_score double, tier string, recommended_action string"
    found = sorted((r.chamber_id, r.window_count, str(r.incident_start_datetime)) for r in alerts.incident_queue(spark.createDataFrame(rows, schema)).collect())
    expected = []
    for c in ("c1", "c2"):
        mine = sorted((r for r in rows if r[1] == c), key=lambda r: ((r[3] is not None, r[3] or T0), (r[4] is not None, r[4] or T0)))
        group, latest = [], None
        for r in mine:
            if group and r[3] is not None and latest is not None and r[3] > latest + dt.timedelta(hours=6):
                expected.append(group)
                group = []
            group.append(r)
            if r[4] is not None and (latest is None or r[4] > latest):
                latest = r[4]
        expected.append(group)
    assert found == sorted((g[0][1], len(g), str(min((r[3] for r in g if r[3] is not None), default=None))) for g in expected)


def test_gap_equal_to_the_limit_joins(spark):
    queue = alerts.action_queue(spark.createDataFrame([("c", hours(0), hours(1)), ("c", hours(7), hours(8)), ("c", hours(15), hours(16))], "chamber_id string, start_datetime timestamp_ntz, end_datetime timestamp_ntz").select("*", F.lit("t").alias("track"), F.lit("d").alias("source_dataset"), F.lit(1.6).alias("track_score"), F.lit(0.0).alias("management_score"), F.lit(0.0).alias("environment_score"), F.lit("high").alias("tier"), F.lit("rectal_temp_high").alias("reason"), F.lit("disease, other").alias("alert_category")))
    rows = alerts.numbered_incidents(alerts.incident_queue(queue)).collect()
    assert sorted(r.window_count for r in rows) == [1, 2] and {r.incident_id for r in rows} == {"disease-0001", "disease-0002"} and {r.priority for r in rows} == {"urgent"}


def test_split_keeps_validation_windows(spark):
    rows = spark.createDataFrame([(g, hours(i)) for g, n in (("long", 100), ("short", 30), ("tiny", 5)) for i in range(n)], "g string, datetime timestamp_ntz")
    tagged, summary = series.split_by_time(rows, ["g"], 0.8, 10, 5)
    found = {r.g: r for r in summary.collect()}
    assert (found["long"].train_rows, found["long"].val_rows, found["long"].status) == (80, 20, "non_overlapping")
    assert found["tiny"].status == "skipped_too_short" and found["tiny"].train_rows == 0
    assert found["short"].val_windows >= 5 and tagged.where("g = 'tiny'").isEmpty()


def test_scaler_refuses_unseen_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    fit = series.fit_scaler(rows.where("g = 'a'"), ["v"], ["g"])
    assert sorted(r.v for r in series.scale(rows.where("g = 'a'"), fit, ["v"], ["g"]).collect()) == [-1.0, 1.0]
    with pytest.raises(Exception, match="no scaler for b"):
        series.scale(rows, fit, ["v"], ["g"]).collect()
    assert {r.v for r in series.scale(rows, series.fit_scaler(rows.where("g = 'b'"), ["v"]), ["v"]).collect()} == {-4.0, -2.0, 0.0}


def test_time_range_is_half_open(spark):
    rows = spark.createDataFrame([("c", T0 + dt.timedelta(days=d), float(d)) for d in (0, 1, 3)], "c string, datetime timestamp_ntz, v double")
    found = {r.v: r for r in series.rolling_features(rows, ["v"], ["c"]).collect()}
    assert found[3.0].v_roll_mean_3d == 2.0 and found[0.0].v_zscore_3d == 0.0 and found[3.0].v_delta == 2.0


def test_quality_helpers(spark):
    df = spark.createDataFrame([("2023-01-05 10:00:00", None, None, "x", 99.0), (None, "230105", "1130", "2.5", -9999.0), ("bad", None, None, None, 1.0)], "timestamp string, date string, time string, v string, s double")
    assert [str(r.datetime) for r in quality.time_index(df).orderBy("datetime").collect()] == ["2023-01-05 10:00:00", "2023-01-05 11:30:00"]
    assert {(r.v, r.w) for r in quality.coerced(df, ["v", "w"]).collect()} == {(None, None), (2.5, None)}
    assert {r.s for r in quality.sentinel_masked(df, ["s"], [-9999.0]).collect()} == {99.0, None, 1.0}
    issues = {(r["column"], r.check) for r in quality.validation_issues(df, ["v", "missing"], ["v", "date"], "time", 60.0).collect()}
    assert issues == {("missing", "required_column"), ("date", "missing_pct"), ("time", "unparsed_pct")}
    assert quality.usable_features(df.withColumn("n", F.lit(None)), ["timestamp"]) == ["date", "time", "v", "s"]
    with pytest.raises(ValueError):
        quality.usable_features(df, df.columns)
    clip = df.limit(1).select(*[c.alias(k) for k, c in quality.clip_parts(F.lit("20230105_ch02_facility3_pen07.mp4")).items()]).first()
    assert (str(clip.clip_date), clip.channel, clip.facility, clip.pen, clip.chamber) == ("2023-01-05", 2, 3, 7, 3)


def test_confusion_is_null_where_undefined(spark):
    df = spark.createDataFrame([(1.0, True), (0.0, True), (None, True), (1.0, None)], "v double, y boolean")
    r = evaluate.confusion(df, "v", 0.5, "y").first()
    assert (r.n, r.tp, r.fn, r.sensitivity, r.specificity, r.precision) == (2, 1, 1, 0.5, None, 1.0)


def test_levels_without_rows_stay(spark):
    df = spark.createDataFrame([("normal", True)], "policy_level string, y boolean")
    assert [(r.policy_level, r.pen_days) for r in penday.level_summary(df, "y").orderBy("policy_rank").collect()] == [("cctv_focus", 0), ("caution", 0), ("observe", 0), ("normal", 1)]


def test_event_joins_on_busy_chambers(spark):
    rng = random.Random(7)
    ev = [(f"e{i}", "c", "fever", hours(rng.randrange(500)), None, 1.0) for i in range(40)]
    ev = [(a, b, c, d, d + dt.timedelta(hours=rng.choice([0, 3, 60])), s) for a, b, c, d, _, s in ev]
    al = [("c", hours(rng.randrange(500)), rng.choice([1, 30]), 1.0, "high", "r") for _ in range(60)]
    al = [(a, b, b + dt.timedelta(hours=n), s, t, r) for a, b, n, s, t, r in al]
    e = spark.createDataFrame(ev, "event_id string, chamber_id string, event_type string, start_datetime timestamp_ntz, end_datetime timestamp_ntz, severity double")
    a = spark.createDataFrame(al, "chamber_id string, start_datetime timestamp_ntz, end_datetime timestamp_ntz, track_score double, tier string, reason string")
    found = sorted((r.event_id, str(r.alert_start), str(r.alert_end)) for r in events.overlaps(e, a).collect())
    assert found == sorted((x[0], str(y[1]), str(y[2])) for x in ev for y in al if max(x[3], y[1]) < min(x[4], y[2]))
    lead = sorted((r.event_id, str(r.alert_start)) for r in events.lead_matches(e, a).collect())
    assert lead == sorted((x[0], str(y[1])) for x in ev for y in al if 0 <= (x[3] - y[1]).total_seconds() <= 72 * 3600)


def joined_rows(df):
    """Rows of df as a bag, and rows that came out of its joins."""
    bag = Counter(tuple(map(repr, r)) for r in df.collect())

    def out(node):
        name = node.nodeName()
        held = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
        return (node.metrics().apply("numOutputRows").value() if name.startswith("SortMergeJoin") else 0) + sum(map(out, held))

    return bag, out(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("copies", [1, 300])
def test_equal_alerts_meet_an_event_once(spark, copies):
    """Alerts that come again are whole in the result, but only those that differ go through the joins; -0.0, NaN and null scores stay as they are."""
    ev = [(f"e{i}", c, "fever", hours(h), hours(h + n), 1.0) for i, (c, h, n) in enumerate([("c", 100, 8), ("c", 100, 8), ("c", 101, 60), ("d", 100, 8), (None, 100, 8), ("c", 160, 8)])]
    ev += [ev[0], ("e9", "c", "fever", None, None, None)]
    kinds = [("c", 99, 24, 0.0, "r"), ("c", 99, 24, -0.0, "r"), ("c", 99, 24, float("nan"), "r"), ("c", 99, 24, None, None), ("c", 99, 30, 0.0, "r"), ("c", 28, 24, 2.0, "s"), ("c", 29, 100, 2.0, ""), (None, 99, 24, 1.0, "r")]
    al = [(c, hours(h), hours(h + n), x, "high", r) for c, h, n, x, r in kinds for _ in range(copies)] + [("c", None, None, 1.0, "high", "r")]
    e = spark.createDataFrame(ev, "event_id string, chamber_id string, event_type string, start_datetime timestamp_ntz, end_datetime timestamp_ntz, severity double")
    a = spark.createDataFrame(al, "chamber_id string, start_datetime timestamp_ntz, end_datetime timestamp_ntz, track_score double, tier string, reason string")
    known = [(x, y) for x in ev for y in al if x[1] is not None and x[1] == y[0] and None not in (x[3], y[1])]
    text = lambda *row: tuple(map(repr, row))
    bag, most = joined_rows(events.overlaps(e, a).select("event_id", "alert_start", "alert_end", "track_score", "reason", "overlap_hours"))
    shared = [(x, y, (min(x[4], y[2]) - max(x[3], y[1])).total_seconds() / 3600) for x, y in known]
    assert bag == Counter(text(x[0], y[1], y[2], y[3], y[5], n) for x, y, n in shared if n > 0)
    assert 0 < most < 200
    bag, most = joined_rows(events.lead_matches(e, a).select("event_id", "alert_start", "track_score", "reason", "lead_hours", "matched_horizons_hours"))
    lead = [(x, y, (x[3] - y[1]).total_seconds() / 3600) for x, y in known]
    assert bag == Counter(text(x[0], y[1], y[3], y[5], n, ",".join(str(h) for h in (24, 48, 72) if n <= h)) for x, y, n in lead if 0 <= n <= 72)
    assert 0 < most < 200


def test_lead_figures_without_pairs(spark):
    """Counts, first and last alert by running sums over blocks of the horizon, against all pairs; times meet both ends of the horizon and of blocks."""
    rng = random.Random(8)
    start = lambda: hours(rng.choice([rng.randrange(500), 72 * rng.randrange(7), 24 * rng.randrange(20)])) if rng.random() < 0.95 else None
    ev = [(f"e{rng.randrange(150)}", rng.choice(["c", "c", "d", None]), rng.choice(["fever", "other"]), start(), 1.0) for i in range(160)]
    al = [(rng.choice(["c", "c", "d", None]), start(), rng.choice([1, 30]), rng.random(), rng.choice(["a", "b"])) for _ in range(120)]
    e = spark.createDataFrame(ev, "event_id string, chamber_id string, event_type string, start_datetime timestamp_ntz, severity double")
    rows = [(c, s, None if s is None else s + dt.timedelta(hours=n), x, k) for c, s, n, x, k in al]
    a = spark.createDataFrame(rows, "chamber_id string, start_datetime timestamp_ntz, end_datetime timestamp_ntz, track_score double, rule_set string")
    pairs = [(x, y, (x[3] - y[1]).total_seconds() / 3600) for x in ev for y in rows if None not in (x[1], x[3], y[1]) and x[1] == y[0] and 0 <= (x[3] - y[1]).total_seconds() <= 72 * 3600]
    of = {}
    for x, y, lead in pairs:
        of.setdefault(x[0], []).append((y, lead))
    found = sorted(((r.event_id, r.lead_alert_count, r.first_alert_start, r.first_lead_hours, r.max_track_score, r.caught_within_24h) for r in events.lead_summary(e, a).collect()), key=repr)
    expected = [(k, len(v), min(y[1] for y, _ in v), max(h for _, h in v), max(y[3] for y, _ in v), min(h for _, h in v) <= 24) if v else (k, 0, None, None, None, False) for k, v in ((x[0], of.get(x[0], [])) for x in ev)]
    assert found == sorted(expected, key=repr)
    metrics = next(r for r in events.lead_metrics(e, a).collect() if r.scope == "all")
    assert metrics.lead_matched_alert_windows == len({y[:3] for _, y, _ in pairs}) and metrics.lead_matched_events == sum(x[0] in of for x in ev)
    sets = {r.rule_set: r.lead_matched_events for r in compare.lead_by_set(e, a).collect()}
    assert sets == {k: len({x[0] for x, y, _ in pairs if y[4] == k}) for k in "ab"}
    plan = compare.lead_by_set(e, a)._jdf.queryExecution().optimizedPlan().toString()
    assert "_day" not in plan and "explode(sequence" not in plan


def test_motion_needs_a_positive_gap(spark):
    boxes = spark.createDataFrame([("v", 1, f, 10.0 * f, 0.0, 2.0, 2.0, 300.0, 400.0) for f in (1, 2, 4)] + [("v", 1, 4, 40.0, 0.0, 2.0, 2.0, None, None)], "source_video string, track_id int, frame long, x double, y double, w double, h double, frame_width double, frame_height double")
    rows = sorted(vision.track_motion(vision.box_geometry(boxes)).collect(), key=lambda r: (r.frame, r.movement is None))
    assert [r.movement for r in rows] == [None, 10.0, 20.0, None] and rows[2].movement_per_frame == 10.0 and rows[1].diagonal == 500.0


def test_isolation_scores_find_the_outlier(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(300)] + [(999, [30.0, -30.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    found = {r.k: r.score for r in models.isolation_scores(df.where("k < 900"), df, "v", "k", 30).collect()}
    assert max(found, key=found.get) == 999


def test_bagged_forest(spark):
    """Three classes of very unequal size, apart by two features that interact; whole clips are held out."""
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        a, b, c = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(-1, 1)
        kind = "rare" if a > 0.8 and b > 0 else ("mixed" if a * b > 0 else "apart")
        rows.append((i, f"clip{i % 25}", kind, a, b, c))
    rows += [(9000, "clip1", None, 0.0, 0.0, 0.0), (9001, "clip2", "rare", None, 0.0, 0.0)]
    df = models.group_hold_out(spark.createDataFrame(rows, "id int, clip string, kind string, a double, b double, c double"), "clip")
    table = models.forest_confusion(df, ["a", "b", "c"], "kind", "id", trees=40)
    found = sorted(map(tuple, table.collect()))
    assert sum(n for _, _, n in found) == 5 * 160 and models.macro_f1(table).first().macro_f1 > 0.9
    assert sorted(map(tuple, models.forest_confusion(df.repartition(7), ["a", "b", "c"], "kind", "id", trees=40).collect())) == found
    assert models.forest_confusion(df.limit(0), ["a"], "kind", "id").count() == 0


def test_a_tree_cuts_where_impurity_falls_most():
    import numpy as np

    x = np.array([[0.0], [1.0], [2.0], [3.0], [4.0], [5.0]])
    tree = models.grown(x, np.array([0, 0, 0, 1, 1, 1]), np.ones(6), 2, 12, np.random.default_rng(0))
    assert tree["feature"] == [0, -1, -1] and tree["cut"][0] == 2.5
    held = {k: np.array(v) for k, v in tree.items()}
    assert models.class_shares(held, np.array([[2.5], [2.6]])).tolist() == [[1.0, 0.0], [0.0, 1.0]]


def test_macro_f1(spark):
    table = spark.createDataFrame([(0.0, 0.0, 8), (0.0, 1.0, 2), (1.0, 1.0, 5)], "label double, prediction double, n int")
    assert models.macro_f1(table).first().macro_f1 == pytest.approx((16 / 18 + 10 / 12) / 2)


def test_plans_stay_native_and_without_products(spark):
    from penlight.plans import alerting, sensor

    for f in (sensor.rule_evaluation, alerting.lead_matches, alerting.incidents):
        plan = f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan
