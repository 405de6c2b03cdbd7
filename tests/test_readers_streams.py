"""Readers on generated files, and streams against their batch forms."""

import datetime
import json
import os
import shutil
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from penlight.operators import alerts, review, rules, series
from penlight.sources import readers
from penlight.streaming import twins


def test_nested_labels_with_alias_paths(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.json").write_text(json.dumps({"ImageInfo": {"chamber-number": "3", "date": "230105"}, "SensorData": {"T": 21.5, "CO2": "x"}, "breath-rate": 30}))
    (tmp_path / "2.json").write_text(json.dumps({"ImageInfo": {"chamber_number": 4}, "annotations": {"pig-number": 7}, "breath_rate": "31.5"}))
    (tmp_path / "3.json").write_text("{broken")
    (tmp_path / "4.txt").write_text("{}")
    rows = {r.source_file[-6:]: r for r in readers.labels(readers.files(spark, str(tmp_path), "*.json")).collect()}
    assert len(rows) == 3 and not rows["3.json"].parsed
    assert (rows["1.json"].chamber_number, rows["1.json"].barn_temperature, rows["1.json"].co2, rows["1.json"].breath_rate) == ("3", 21.5, None, 30.0)
    assert (rows["2.json"].chamber_number, rows["2.json"].pig_number, rows["2.json"].breath_rate) == ("4", "7", 31.5)
    assert readers.files(spark, str(tmp_path), "*.json", 2).count() == 2


def test_archives_keep_bad_members_apart(spark, tmp_path):
    good = {"IMAGE": {"IMAGE_FILE_NAME": "f1.jpg"}, "ANNOTATION_INFO": [{"ID": "1", "ACTION_NAME": "Walk", "ESTRUS": "Y", "INJECTION": "N", "KEYPOINTS": [0, 0, 1, 10, 20, 2, 99, 99, 0]}, {"ID": "2", "ACTION_NAME": "Lie", "KEYPOINTS": []}]}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.json", json.dumps(good))
        z.writestr("b.json", "{no")
        z.writestr("c.txt", "no")
    (tmp_path / "y.zip").write_bytes(b"not a zip")
    members, bad = readers.quarantined(readers.archive_members(spark, str(tmp_path), ".json"))
    assert {(r.member, r.problem) for r in bad.collect()} == {("b.json", "not JSON"), (None, "BadZipFile")}
    rows = {r.animal: r for r in readers.keypoint_rows(members).collect()}
    assert (rows["1"].action, rows["1"].estrus, rows["1"].injection, rows["1"].visible_points, rows["1"].center_x, rows["1"].span_y) == ("walk", 1, 0, 2, 5.0, 20.0)
    assert rows["2"].visible_points == 0 and rows["2"].center_x is None


def test_csv_forms(spark, tmp_path):
    (tmp_path / "north.csv").write_text("chamber,value\n1, 2.5\n2,x\n")
    (tmp_path / "south.csv").write_text("chamber,value\n3,4\n")
    rows = {(r.dataset_key, r.chamber, r.value) for r in readers.csv_union(spark, [str(tmp_path / "north.csv"), str(tmp_path / "south.csv")], "chamber int, value double").collect()}
    assert rows == {("north", 1, 2.5), ("north", 2, None), ("south", 3, 4.0)}
    with pytest.raises(ValueError):
        readers.csv_union(spark, [], "chamber int")
    (tmp_path / "Exp7").mkdir()
    (tmp_path / "Exp7/r.csv").write_text("station,pen\n1,A1\n")
    assert readers.experiment_files(spark, str(tmp_path / "Exp7"), "station int, pen string").first().experiment == 7
    with pytest.raises(ValueError, match="conf"):
        readers.tracking_boxes(spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0)], "frame long, track_id long, x double, y double, w double, h double"))


def test_rule_files(spark, tmp_path):
    doc = {"combine": "OR", "rules": [{"id": "a", "feature": "x", "agg": "max", "op": ">=", "threshold": 3, "severity": "high", "category": "disease"}, {"id": "b", "severity": "low", "category": "environment", "all_of": [{"feature": "x", "agg": "min", "op": "<=", "threshold": 1}]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    table = rules.rule_rows(readers.rule_config(spark, str(tmp_path / "r.json")))
    assert {(r.rule_id, r.is_composite, r.threshold) for r in table.collect()} == {("a", False, 3.0), ("b", True, None)}
    assert readers.rule_thresholds(table, {"a": 1.0, "c": 2.0, "b": None}) == {"a": 3.0, "c": 2.0, "b": None}


def test_sinks(spark, tmp_path):
    queue = spark.createDataFrame([("disease", 1), ("management", 2)], "queue string, n int")
    readers.write_queue(queue, str(tmp_path / "q"))
    assert {p.name for p in (tmp_path / "q").iterdir() if p.is_dir()} == {"queue=disease", "queue=management"}
    readers.write_features({"f": queue}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/f")).count() == 2


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def source(spark, tmp_path, df, name):
    df.repartition(1).write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def test_tumbling_and_sliding_equal_batch(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 3).alias("chamber"), F.timestamp_seconds(F.col("id") * 60).alias("datetime"), F.col("id").cast("double").alias("t"))
    found = run(twins.tumbling(source(spark, tmp_path, rows, "a"), ["t"], ["chamber"]), "tumble", "complete")
    batch = series.dense_bins(rows, ["t"], ["chamber"], 600)
    assert {(r.chamber, str(r.datetime), r.t) for r in found.collect()} == {(r.chamber, str(r.datetime), r.t) for r in batch.collect()}
    slid = run(twins.sliding(source(spark, tmp_path, rows, "b"), "t", ["chamber"], "2 hours", "1 hour"), "slide", "complete")
    assert slid.count() > 0 and slid.where("t_mean is null").isEmpty()


def run_files(stream, name, spark):
    """Runs a query over a source that gives one file at a time, until nothing is left."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def trickle(spark, tmp_path, parts, name):
    """Each DataFrame of parts as a file that comes after those before."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        for file in (tmp_path / name).glob("part-*.parquet"):
            file.rename(tmp_path / name / f"{i:03d}-{file.name.removeprefix('part-')}")
            os.utime(tmp_path / name / f"{i:03d}-{file.name.removeprefix('part-')}", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


WINDOWS = "queue string, chamber_id string, reason string, start_datetime timestamp, end_datetime timestamp, track_score double, management_score double, environment_score double"


def alert_windows(spark, rows):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    return spark.createDataFrame([(q, c, r, at(s), at(e), t, None, 0.5) for q, c, r, s, e, t in rows], WINDOWS)


def test_sessions_of_mixed_length_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(160):
        start = float(rng.integers(0, 400))
        # Some windows outlast several that begin after them.
        rows.append(("disease", f"c{k % 3}", "r", start, start + float(rng.choice([0, 1, 2, 30])), None if k % 9 == 0 else float(k)))
    rows.sort(key=lambda r: r[3])
    # Within the lateness of 12 hours the order is mixed.
    mixed = sorted(rows, key=lambda r: r[3] + float(rng.uniform(0, 11)))
    end = [("disease", "last", "r", 5000.0, 5000.0, 0.0)]
    parts = [alert_windows(spark, mixed[i : i + 23]) for i in range(0, len(mixed), 23)] + [alert_windows(spark, end)]
    found = run_files(twins.sessions(trickle(spark, tmp_path, parts, "mixed"), late="12 hours"), "mixed", spark)
    queue = alert_windows(spark, rows).selectExpr("*", "1 as priority_rank", "'p' as priority", "'t' as track", "'s' as source_dataset", "'' as tier", "'a' as recommended_action")
    batch = alerts.incident_queue(queue)
    names = ["chamber_id", "incident_start_datetime", "incident_end_datetime", "window_count", "max_track_score", "max_management_score", "max_environment_score"]
    expected = sorted(tuple(r) for r in batch.select(*names).collect())
    assert sorted(tuple(r) for r in found.select(*names).collect()) == expected
    assert len({r[3] for r in expected}) > 4


def test_rules_on_arriving_windows(spark, tmp_path):
    windows = spark.createDataFrame([("k", 5.0), ("l", None), ("m", 1.0)], "k string, x__wmax double")
    rule = [{"id": "r", "feature": "x", "agg": "max", "op": ">=", "threshold": 3.0, "severity": "high", "category": "disease"}]
    hits = run(twins.scored(source(spark, tmp_path, windows, "w"), rule, ["k"]), "hits")
    assert {(r.k, r.rule_r) for r in hits.collect()} == {("k", True), ("l", False), ("m", False)}


def hours_of(spark, rows, schema, name):
    return spark.createDataFrame(rows, schema).withColumn(name, F.timestamp_seconds(F.col("h") * 3600))


def test_leads_keep_events_without_alerts(spark, tmp_path):
    events = [("c", "e1", 100), ("c", "e2", 400), ("d", "e3", 100), (None, "e4", 90)]
    alerts_ = [("c", 90, 1.0), ("c", 40, 7.0), ("c", 20, 2.0), ("c", 101, 3.0), (None, 90, 4.0)]
    e = [hours_of(spark, x, "chamber_id string, event_id string, h int", "event_start") for x in (events, [("z", "end", 9000)], [("z", "end2", 9001)])]
    a = [hours_of(spark, x, "chamber_id string, h int, track_score double", "alert_start") for x in (alerts_, [("y", 9000, 0.0)], [("y", 9001, 0.0)])]
    lead = run_files(twins.lead_matches(trickle(spark, tmp_path, e, "e"), trickle(spark, tmp_path, a, "a")), "lead", spark)
    assert {(r.event_id, r.track_score) for r in lead.collect()} >= {("e1", 1.0), ("e1", 7.0), ("e2", None), ("e3", None), ("e4", None)}
    out = run_files(twins.lead_outcomes(trickle(spark, tmp_path, e, "e5"), trickle(spark, tmp_path, a, "a5")), "outcomes", spark)
    found = {r.event_id: (r.lead_alert_count, r.first_lead_hours, r.max_track_score, r.caught_within_24h, r.caught_within_72h) for r in out.collect()}
    assert found["e1"] == (2, 60.0, 7.0, True, True)
    assert found["e2"] == found["e3"] == found["e4"] == (0, None, None, False, False)


def test_streamed_confirmation_equals_batch(spark, tmp_path):
    flags = [("c", i, i in (1, 2, 4, 5, 6, 7, 9)) for i in range(10)] + [("d", i, True) for i in range(2)]
    rows = spark.createDataFrame(flags, "chamber_id string, at long, flag boolean")
    found = run(twins.confirmed(source(spark, tmp_path, rows, "f")), "conf")
    batch = series.confirm_runs(rows, "flag", ["chamber_id"], ["at"], 3).where("confirmed")
    assert {tuple(r) for r in found.collect()} == {(r.chamber_id, r["at"]) for r in batch.collect()} == {("c", i) for i in (4, 5, 6, 7)}


DECISIONS = "incident_id string, decision string, resolved_at string, reviewed_by string, sequence int"


def files_of(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in sorted(path.rglob("*.parquet"))}


def test_review_upserts(spark, tmp_path):
    log = review.template(spark.createDataFrame([(f"i{i}", "disease") for i in range(200)], "incident_id string, queue string"), ["incident_id", "queue"])
    first = spark.createDataFrame([("i1", "Confirmed", "t1", None, 1), ("i1", "dismissed", "t2", "me", 2), ("zz", "confirmed", "t", "", 3), ("i2", "what", "t", "", 4)], DECISIONS)
    second = spark.createDataFrame([("i3", "confirmed", "t3", "you", 1), ("i1", "confirmed", "t4", "you", 2)], DECISIONS)
    out = tmp_path / "out"
    q = twins.review_upserts(trickle(spark, tmp_path, [first, second], "d"), log, str(out), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    rows = {r.incident_id: r for r in twins.review_log(spark, str(out)).collect()}
    assert len(rows) == 200 and (rows["i1"].review_status, rows["i1"].reviewed_by, rows["i2"].review_status, rows["i3"].review_status) == ("confirmed", "you", "pending", "confirmed")
    before = {r.incident_id: r for r in twins.review_log(spark, str(out), 0).collect()}
    assert (before["i1"].review_status, before["i1"].reviewed_by, before["i3"].review_status) == ("false_alarm", "me", "pending")
    # Both batches give the log that all decisions give at once, in their order.
    at_once = review.decided(log, first.unionByName(second.withColumn("sequence", F.col("sequence") + 10)))
    assert sorted(map(str, at_once.collect())) == sorted(map(str, rows.values()))
    assert spark.read.parquet(str(out / "history")).count() == 4
    # Only parts with decisions have a new version.
    assert 1 <= len(list((out / "data/version=1").glob("part=*"))) <= 2


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    log = review.template(spark.createDataFrame([(f"i{i}", "disease") for i in range(50)], "incident_id string, queue string"), ["incident_id", "queue"])
    said = [spark.createDataFrame([(f"i{i}", "confirmed", "t", "a", 1), ("i7", "dismissed" if i else "confirmed", "t", "a", 2)], DECISIONS) for i in range(3)]
    out = tmp_path / "out"
    twins.start_review_log(log, str(out))
    for no, batch in enumerate(said):
        twins.apply_decisions(batch, no, str(out))
    held = files_of(out)
    for no in (2, 1, 0):
        twins.apply_decisions(said[no], no, str(out))
    twins.start_review_log(log, str(out))
    assert files_of(out) == held
    # A batch that failed before its commit is done again from the batch before.
    shutil.rmtree(out / "manifest/batch=2")
    twins.apply_decisions(said[2], 2, str(out))
    rows = {r.incident_id: r.review_status for r in twins.review_log(spark, str(out)).collect()}
    assert (rows["i0"], rows["i1"], rows["i2"], rows["i3"], rows["i7"]) == ("confirmed", "confirmed", "confirmed", "pending", "false_alarm")
    assert spark.read.parquet(str(out / "history")).count() == 6


def test_single_decisions(spark):
    log = review.template(spark.createDataFrame([("i1", "disease")], "incident_id string, queue string"), ["incident_id", "queue"])
    with pytest.raises(KeyError):
        review.single(log, "zz", "confirmed")


def test_decisions_on_an_empty_log(spark, tmp_path):
    log = review.template(spark.createDataFrame([], "incident_id string, queue string"), ["incident_id", "queue"])
    twins.start_review_log(log, str(tmp_path / "out"))
    twins.apply_decisions(spark.createDataFrame([("i1", "confirmed", "t", "a", 1)], DECISIONS), 0, str(tmp_path / "out"))
    assert twins.review_log(spark, str(tmp_path / "out")).count() == 0
