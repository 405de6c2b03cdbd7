"""Bounded parts of long histories against whole ones, in plain Python."""

import datetime
import statistics

import numpy as np
import pytest

from penlight.operators import alerts, histories, series

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(params=[(30, 100_000), (1, 7)])
def parts(request, monkeypatch):
    """As they are, and so small that every history has many."""
    monkeypatch.setattr(histories, "BUCKET_DAYS", request.param[0])
    monkeypatch.setattr(histories, "RUN_ROWS", request.param[1])


def hours():
    """One chamber has half of the rows; there are gaps of many days and an entity without a key."""
    rng = np.random.default_rng(6)
    out = {}
    for key, n in (("hot", 240), ("a", 120), (None, 90), ("b", 29), ("lone", 1)):
        at = np.cumsum(rng.choice([1, 1, 1, 2, 5, 30, 400], n))
        out[key] = [(START + datetime.timedelta(hours=int(h)), None if i % 11 == 3 else float(np.round(rng.normal(), 3))) for i, h in enumerate(at)]
    return out


def table(spark, held):
    rows = [(k, t, v, i) for k, x in held.items() for i, (t, v) in enumerate(x)]
    return spark.createDataFrame(rows, "key string, datetime timestamp_ntz, x double, no int")


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_rolling_features(spark, parts):
    held = hours()
    found = {(r.key, r.no): r for r in series.rolling_features(table(spark, held), ["x"], ["key"]).collect()}
    assert len(found) == sum(map(len, held.values()))
    for key, rows in held.items():
        for i, (t, v) in enumerate(rows):
            near = [w for u, w in rows[: i + 1] if u > t - datetime.timedelta(days=3) and w is not None]
            mean = statistics.fmean(near) if near else None
            std = statistics.stdev(near) if len(near) > 1 else 0.0
            before = rows[i - 1][1] if i else None
            r = found[key, i]
            assert close(r.x_roll_mean_3d, mean) and close(r.x_roll_std_3d, std)
            assert close(r.x_zscore_3d, (v - mean) / std if std and v is not None else 0.0)
            assert close(r.x_delta, v - before if v is not None and before is not None else 0.0)


@pytest.mark.parametrize("length", [1, 5, 30])
def test_windows_of_rows(spark, parts, length):
    held = hours()
    df = table(spark, held)
    expected = {}
    for key, rows in held.items():
        for i in range(len(rows) - length + 1):
            values = [v for _, v in rows[i : i + length] if v is not None]
            expected[key, rows[i][0]] = (rows[i + length - 1][0], i, max(values, default=None), min(values, default=None))
    found = series.window_table(df, ["x"], ["key"], length).collect()
    assert {(r.key, r.start_datetime): (r.end_datetime, r.window_start_index, r.x__wmax, r.x__wmin) for r in found} == expected and len(found) == len(expected)
    made = series.sequences(df, ["x"], ["key"], length, last=["no"]).collect()
    assert {(r.key, r.start_datetime): (r.end_datetime, r.end_no) for r in made} == {k: (v[0], v[1] + length - 1) for k, v in expected.items()}


def test_numbers_of_rows(spark, parts):
    rows = histories.numbered(table(spark, hours()).repartition(5), ["key"], ["datetime"], "i").collect()
    assert all(r.i == r.no for r in rows) and len(rows) == 480


def lengths(flags):
    out, i = [], 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j]:
            j += 1
        out += [j - i] * (j - i) if j > i else [0]
        i = j if j > i else i + 1
    return out


@pytest.mark.parametrize("share", [0.2, 0.8, 0.98])
def test_runs_through_buckets(spark, parts, share):
    rng = np.random.default_rng(9)
    held = {k: [(t, bool(rng.random() < share) if i % 50 else None) for i, (t, _) in enumerate(x)] for k, x in hours().items()}
    held["all"] = [(START + datetime.timedelta(hours=20 * i), True) for i in range(60)]
    rows = [(k, t, v, i) for k, x in held.items() for i, (t, v) in enumerate(x)]
    df = spark.createDataFrame(rows, "key string, at timestamp, flag boolean, no int")
    expected = {(k, i): n for k, x in held.items() for i, n in enumerate(lengths([bool(v) for _, v in x]))}
    found = series.confirm_runs(df, "flag", ["key"], ["at", "no"], 3).collect()
    assert {(r.key, r.no): r.confirmed for r in found} == {k: n >= 3 for k, n in expected.items()} and len(found) == len(rows)
    # An order that is no time has one bucket.
    plain = series.confirm_runs(df, "flag", ["key"], ["no"], 3).collect()
    assert {(r.key, r.no): r.confirmed for r in plain} == {k: n >= 3 for k, n in expected.items()}


def test_incidents_through_buckets(spark, parts):
    rng = np.random.default_rng(10)
    windows = []
    for key, n in (("hot", 150), ("a", 60), (None, 20)):
        for i in range(n):
            start = START + datetime.timedelta(hours=float(rng.integers(0, 2500)))
            # Some last for weeks, over many windows that begin after them.
            windows.append((key, start, start + datetime.timedelta(hours=float(rng.choice([1, 2, 700]))) if i % 17 else None, float(i)))
    windows.append(("a", None, START, 1.0))
    schema = "queue string, chamber_id string, reason string, start_datetime timestamp_ntz, end_datetime timestamp_ntz, track_score double"
    df = spark.createDataFrame([("disease", k, "r", s, e, t) for k, s, e, t in windows], schema)
    queue = df.selectExpr("*", "0.0 as management_score", "0.0 as environment_score", "1 as priority_rank", "'p' as priority", "'t' as track", "'s' as source_dataset", "'' as tier", "'a' as recommended_action")
    expected = []
    for key in ("hot", "a", None):
        mine = sorted([w for w in windows if w[0] == key], key=lambda w: (w[1] or datetime.datetime.min, w[2] or datetime.datetime.min, w[3]))
        end, group = None, []
        for w in mine:
            if group and w[1] and end and w[1] > end + datetime.timedelta(hours=6):
                expected.append((key, group))
                group = []
            group.append(w)
            end = max([x for x in (end, w[2]) if x], default=None)
        expected.append((key, group))
    want = sorted(((str(k), min((w[1] for w in g if w[1]), default=None), max((w[2] for w in g if w[2]), default=None), len(g), max(w[3] for w in g)) for k, g in expected), key=repr)
    found = alerts.incident_queue(queue).collect()
    assert sorted(((str(r.chamber_id), r.incident_start_datetime, r.incident_end_datetime, r.window_count, r.max_track_score) for r in found), key=repr) == want


def test_motion_and_posture_changes_by_parts(spark, monkeypatch):
    """Steps from the box before and changes of posture across parts, some of them empty, as over whole tracks; no task needs a whole one."""
    from penlight.operators import vision

    monkeypatch.setattr(histories, "ORDER_STEP", 10)
    rng = np.random.default_rng(9)
    boxes, expected = [], {}
    for track in (1, 2, 3):
        frames = sorted(rng.choice(400, 60, replace=False).tolist())
        xs = [float(x) for x in rng.integers(0, 100, 60)]
        boxes += [("v", track, f, x, 0.0, 100.0) for f, x in zip(frames, xs)]
        expected |= {(track, f): (None if i == 0 else f - frames[i - 1], None if i == 0 else abs(x - xs[i - 1])) for i, (f, x) in enumerate(zip(frames, xs))}
    found = vision.track_motion(spark.createDataFrame(boxes, "source_video string, track_id int, frame long, center_x double, center_y double, diagonal double"))
    assert {(r.track_id, r.frame): (r.frame_gap, r.movement) for r in found.collect()} == expected
    rows = [(k, START + datetime.timedelta(hours=int(h)), i, str(rng.choice(["lying", "walking"])), str(rng.choice(["hot", "cool"]))) for k in "ab" for i, h in enumerate(np.cumsum(rng.choice([1, 2, 5, 30, 90], 120)))]
    frame = spark.createDataFrame(rows, "key string, datetime timestamp_ntz, no int, label string, condition string").selectExpr("*", "cast(datetime as date) as bin", "cast(no as double) as x")
    shares = vision.posture_shares(frame, ["key"], "label", ["lying"], ["datetime", "no"], ["x"], "condition", "bin")
    bins = {}
    for j, (k, t, i, label, condition) in enumerate(rows):
        bins.setdefault((k, t.date()), []).append((label == "lying", i > 0 and rows[j - 1][3] != label, i, condition))
    wanted = {b: (statistics.mean(r[0] for r in v), statistics.mean(r[1] for r in v), statistics.mean(r[2] for r in v), min(("cool", "hot"), key=lambda c: (-sum(r[3] == c for r in v), c)), len(v)) for b, v in bins.items()}
    got = {(r.key, r.bin): (r.lying_share, r.change_rate, r.x, r.condition, r.rows) for r in shares.collect()}
    assert got.keys() == wanted.keys() and all(close(a, b) if isinstance(a, float) else a == b for k in got for a, b in zip(got[k], wanted[k]))
    for df in (found, shares):
        assert "_bucket" in df._jdf.queryExecution().optimizedPlan().toString()
