"""Archives and folders of label documents with known results."""

import datetime
import json
import struct
import zipfile
import zlib

import pytest

from penlight.sources import archives, readers

LABEL = {
    "ImageInfo": {"chamber-number": 3, "video-category": "top", "videoid": "v1", "pig-classification": "sow", "pig-number": "7", "breathing-type": "fast", "date": 230105, "time": 930, "timestamp": " 42 "},
    "annotations": {"distance": "1.5", "keypoint-top": [[1, 2], ["3", 6]]},
    "TextInfo": {"weight": "80.5"},
    "SensorData": {"T": 21.5, "RH": "x", "CO2": None, "NH3": 4},
    "breath-rate": 30,
    "TemperatureData": {"rectal-temperature": 39.1, "back-temperature": 38, "neck-temperature": "37.5", "head-temperature": []},
    "evaporation": 1, "pig-manure": 2, "sensibleHeat": 3, "sensibleHeat(kW)": 4, "latentHeat": 5, "latentHeat(kW)": 6,
    "FeedingAndManagementData": {"ventilation-rate": 7, "feedstuff_volume": 8, "watersupply": "9"},
}
XML = """<?xml version="1.0" encoding="utf-8"?><annotations><meta><task><source>20230105_0930_1000_CH02_P3_07_a.mp4</source><original_size><width>640</width><height>480</height></original_size></task></meta>
<image id="5" name="f5.png" width="100.0" height="50"><points label="lying" occluded="1" points="1,2;3,6;5,1"/><box label="pig" occluded="0" xtl="0" ytl="0" xbr="10" ybr="20"/><points label="none" points=""/></image>
<image id="6" name="f6.png"/><image id="7"><box label="b" xtl="1" ytl="1" xbr="2" ybr="x"/></image></annotations>"""


def zipped(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_every_column_of_an_archived_label(spark, tmp_path):
    zipped(tmp_path / "71408/1.Training/a.zip", {"x/호흡/1.json": json.dumps(LABEL), "evap.json": "{}", "list.json": "[1]", "bad.json": "{", "note.txt": "{}"})
    (tmp_path / "71408/b.zip").write_bytes(b"PK no zip")
    found = archives.members(spark, str(tmp_path), ".json")
    rows = {r.member_name: r.asDict() for r in archives.archive_labels(found).collect()}
    path = f"{tmp_path}/71408/1.Training/a.zip"
    assert rows["x/호흡/1.json"] == {
        "dataset_key": "71408", "split": "training", "kind": "breathing", "source_zip": path, "member_name": "x/호흡/1.json", "label_path": f"{path}!x/호흡/1.json", "chamber_number": "3", "video_category": "top", "video_id": "v1", "pig_classification": "sow", "pig_number": "7", "breathing_type": "fast",
        "date": "230105", "time": "930", "datetime": datetime.datetime(2023, 1, 5, 9, 30), "frame_number": 42, "weight": 80.5, "T": 21.5, "RH": None, "CO2": None, "NH3": 4.0, "breath_rate": 30.0, "distance": 1.5, "rectal_temperature": 39.1, "back_temperature": 38.0, "neck_temperature": 37.5, "head_temperature": None,
        "evaporation": 1.0, "ventilation_rate": 7.0, "feedstuff_volume": 8.0, "watersupply": 9.0, "pig_manure": 2.0, "sensible_heat": 3.0, "sensible_heat_kw": 4.0, "latent_heat": 5.0, "latent_heat_kw": 6.0, "center_x": 2.0, "center_y": 4.0,
    }
    assert set(rows) == {"x/호흡/1.json", "evap.json"} and rows["evap.json"]["kind"] == "evaporation"
    assert all(v is None for c, v in rows["evap.json"].items() if c in archives.LABELS or c in ("datetime", "frame_number", "center_x"))
    _, bad = readers.quarantined(readers.archive_members(spark, str(tmp_path), ".json"))
    assert {(r.member, r.problem) for r in bad.collect()} == {("bad.json", "not JSON"), (None, "BadZipFile")}


@pytest.mark.parametrize("part_bytes", [None, 300])
def test_parts_of_archives_read_every_member_once(spark, tmp_path, part_bytes):
    for k in range(3):
        zipped(tmp_path / f"{k}.zip", {f"{k}/{i}.json": json.dumps({"i": i, "k": k}) for i in range(20)})
    found = archives.members(spark, str(tmp_path), ".json", part_bytes=part_bytes)
    assert sorted(r.member for r in found.collect()) == sorted(f"{k}/{i}.json" for k in range(3) for i in range(20))
    assert part_bytes is None or found.rdd.getNumPartitions() > 3


def test_annotations_have_clip_and_frame_time(spark, tmp_path):
    zipped(tmp_path / "2.Validation/c.zip", {"clip_CH09_P1/annotations.xml": XML, "other/annotations.xml": "<annotations><image", "skip.xml": XML})
    found = archives.members(spark, str(tmp_path), "annotations.xml", "frames")
    assert [r.problem for r in found.where("problem is not null").collect()] == ["ParseError"]
    rows = {(r.frame_id, r.annotation_type): r for r in archives.frame_annotations(found).collect()}
    assert set(rows) == {(5, "points"), (5, "box"), (7, "box")}
    r = rows[5, "points"]
    assert (r.clip_name, r.source_video, r.clip_start_datetime) == ("clip_CH09_P1", "20230105_0930_1000_CH02_P3_07_a.mp4", datetime.datetime(2023, 1, 5, 9, 30))
    assert (r.chamber_number, r.facility_number, r.pen_number, r.split) == (2, 3, 7, "validation")
    assert (r.datetime, r.frame_name, r.image_width, r.image_height, r.label, r.occluded) == (datetime.datetime(2023, 1, 5, 9, 30, 5), "f5.png", 100, 50, "lying", "1")
    # The centre is the mean of the points, not the middle of their span.
    assert (r.point_count, r.center_x, r.center_y, r.span_x, r.span_y) == (3, 3.0, 3.0, 4.0, 5.0)
    b = rows[5, "box"]
    assert (b.point_count, b.center_x, b.center_y, b.span_x, b.span_y, b.occluded) == (0, 5.0, 10.0, 10.0, 20.0, "0")
    assert (rows[7, "box"].image_width, rows[7, "box"].image_height, rows[7, "box"].center_x, rows[7, "box"].center_y) == (640, 480, 1.5, None)


def test_a_member_of_200_megabytes(spark, tmp_path):
    points = ";".join(["10,20", "30,60"] * 10_000)
    image = f'<image id="%d" name="f" width="9" height="9"><points label="lying" points="{points}"/></image>\n'
    n = -(-200_000_000 // len(image))
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("clip/annotations.xml", "w", force_zip64=True) as f:
        f.write(b"<annotations>")
        for i in range(n):
            f.write((image % i).encode())
        f.write(b"</annotations>")
    found = archives.members(spark, str(tmp_path), "annotations.xml", "frames")
    sizes = archives.frame_annotations(found).selectExpr("count(*) as n", "sum(point_count) as points", "max(frame_id) as last", "avg(center_x) as x").head()
    assert tuple(sizes) == (n, 20_000 * n, n - 1, 20.0)


def png(path, width, height):
    path.parent.mkdir(parents=True, exist_ok=True)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IEND", b""))


def test_folders_of_three_forms(spark, tmp_path):
    loose, labels = tmp_path / "loose", tmp_path / "loose/02.라벨링데이터/호흡량 데이터"
    labels.mkdir(parents=True)
    for name, chamber, time in (("b", 2, 1000), ("a", None, 900), ("c", 1, None), ("d", 1, 800)):
        info = {"chamber-number": chamber, "date": 230105, "time": time}
        (labels / f"{name}.json").write_text(json.dumps({"ImageInfo": info, "annotations": {"bbox": [10, 20, 30, 40], "available-area-bbox": [0, 0, 100, 100]}}))
    png(loose / "01.원천데이터/호흡량 이미지/b.png", 200, 100)
    assert archives.write_normalised(spark, str(loose), str(tmp_path / "out")) == "loose"
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    by_chamber = sorted(rows, key=lambda r: (r.chamber_number is None, r.chamber_number or "", r.datetime is None, r.datetime))
    assert [r.label_path[-6] for r in by_chamber] == ["d", "c", "b", "a"]
    b = by_chamber[2]
    assert (b.kind, b.image_width, b.image_height, b.center_x, b.center_y, b.bbox_area_ratio, b.available_area_ratio, b.image_path[-5:]) == ("breathing", 200, 100, 25.0, 40.0, 0.06, 0.5, "b.png")
    assert by_chamber[0].image_path == "" and by_chamber[0].bbox_area_ratio is None
    # Within every written file the order holds, nulls last.
    zipped(tmp_path / "zips/x.zip", {f"{i}.json": json.dumps({"ImageInfo": {"chamber-number": [None, 2, 1][i % 3]}}) for i in range(9)})
    zipped(tmp_path / "zips/y.zip", {"a/annotations.xml": XML})
    assert archives.write_normalised(spark, str(tmp_path / "zips"), str(tmp_path / "out2")) == "json"
    found = spark.read.parquet(str(tmp_path / "out2")).selectExpr("chamber_number as c", "_metadata.file_name as f", "monotonically_increasing_id() as i").orderBy("f", "i").collect()
    assert [r.c for r in found] == ["1"] * 3 + ["2"] * 3 + [None] * 3
    zipped(tmp_path / "xml/y.zip", {"a/annotations.xml": XML})
    assert archives.write_normalised(spark, str(tmp_path / "xml"), str(tmp_path / "out3")) == "xml"
    assert spark.read.parquet(str(tmp_path / "out3")).count() == 3
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        archives.normalised(spark, str(tmp_path / "none"))


def test_clinical_tables_below_two_header_lines(spark, tmp_path):
    head = "Pig identification,Group,Pen number,Day,Temperature,\npigid,trt,pen,dpi,temp,\n"
    (tmp_path / "t").mkdir()
    (tmp_path / "t/1.csv").write_text(head + "1,A,4,-3,39.5,x\n2,B,5,day,39.1,\n")
    (tmp_path / "t/2.csv").write_text(head + "3,A,4,7,,\npigid,trt,pen,dpi,temp,\n4,A,4,8,40.25,\n")
    rows = readers.promoted_header(spark, str(tmp_path / "t"))
    assert rows.columns == ["source_file", "pigid", "trt", "pen", "dpi", "temp"] and rows.count() == 4
    assert sorted(map(tuple, readers.rectal_temperatures(rows).collect())) == [("1", "A", "4", -3.0, 39.5), ("4", "A", "4", 8.0, 40.25)]
    (tmp_path / "t/3.csv").write_text(head.replace("pigid", "pig") + "1,A,4,-3,39.5,x\n")
    with pytest.raises(ValueError, match="differently"):
        readers.promoted_header(spark, str(tmp_path / "t"))
    signs = ",".join(readers.CLINICAL_SIGNS)
    (tmp_path / "s.csv").write_text(f"a,b,c,d,{','.join('efghijkl')}\npigid,trt,pen,dpi,{signs}\n1,A,2,3,1,2(GREASY),,x,0,0,0,1\n1,A,2,4,,,,,,,,\n1,A,2,31,1,1,1,1,1,1,1,1\n")
    assert [(r.dpi, r.clinical_score) for r in readers.clinical_scores(readers.promoted_header(spark, str(tmp_path / "s.csv"))).orderBy("dpi").collect()] == [(3.0, 4.0), (4.0, None)]
    counts = spark.createDataFrame([("1", "A", "2", "3", "4", "5", "x", "1"), ("1", "A", "2", None, "4", "5", "1", "1")], "pigid string, treatment string, pen string, dpi string, active_am string, active_pm string, inactive_am string, inactive_pm string")
    assert [tuple(r) for r in readers.activity_counts(counts).collect()] == [("1", "A", "2", 3.0, 9.0, None)]
    loads = spark.createDataFrame([("1", "A", "2", "3", "5.5"), ("1", "A", "2", "4", "n.d.")], "pigid string, treatment string, pen string, dpi string, `log10rna/ml` string")
    assert [tuple(r) for r in readers.viral_loads(loads).collect()] == [("1", "A", "2", 3.0, 5.5)]
    drugs = spark.createDataFrame([("1", "A", "2", "3", "salve")], "pigid string, treatment string, pen string, dpi string, `Medical treatment` string")
    assert [tuple(r) for r in readers.medical_treatments(drugs).collect()] == [("1", "A", "2", 3.0, "salve")]
