"""Zip archives of label documents, and folders of them as one table.

`archive_members` is a data source: it lists the archives, and a task opens those of its
part, or the members of its byte range where an archive is larger than a part. Only the
members asked for are read, one at a time. Members that hold many frames can be read frame
by frame, so that none has to fit into memory. Paths are whatever pyarrow's file systems
open: local folders, HDFS, object stores.

Everything after the text of a member is built-in functions.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as file_systems
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of archives in a part, and bytes of text that are handed over at once.
PART_BYTES, BATCH_BYTES = 256 << 20, 8 << 20
BROKEN = (zipfile.BadZipFile, pa.ArrowInvalid, UnicodeDecodeError, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError, zlib.error)
SCHEMA = "archive string, member string, source string, width string, height string, text string, problem string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class ArchivePart(InputPartition):
    """Archives, each with the range of bytes in which its members begin."""

    ranges: list[tuple[str, int, int]]


class ArchiveMembers(DataSource):
    """Options: path, suffix of the members, and form: text (whole members), frames (a row for each <image> element of XML members, with the clip's source and size), names."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], self.options.get("suffix", ""), self.options.get("form", "text"), int(self.options.get("part_bytes", PART_BYTES)))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, suffix: str, form: str, part_bytes: int):
        self.path, self.suffix, self.form, self.part_bytes = path, suffix, form, part_bytes

    def partitions(self) -> Sequence[InputPartition]:
        parts: list[ArchivePart] = []
        held, size = [], 0
        for archive, n in listed(self.path, ".zip"):
            for at in range(0, max(n, 1), self.part_bytes):
                end = min(at + self.part_bytes, n)
                held.append((archive, at, end))
                size += end - at
                if size >= self.part_bytes:
                    parts.append(ArchivePart(held))
                    held, size = [], 0
        return [*parts, ArchivePart(held)] if held or not parts else parts

    def read(self, partition: ArchivePart) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in self.rows(partition):
            rows.append(row)
            size += len(row[5] or "")
            if size >= BATCH_BYTES or len(rows) >= 10_000:
                yield batch_of(rows)
                rows, size = [], 0
        yield batch_of(rows)

    def rows(self, partition: ArchivePart) -> Iterator[tuple]:
        system, _ = file_systems.FileSystem.from_uri(self.path)
        for archive, start, end in partition.ranges:
            try:
                with system.open_input_file(archive) as file, zipfile.ZipFile(file) as z:
                    for info in sorted(z.infolist(), key=lambda i: i.filename):
                        if start <= info.header_offset < end and info.filename.endswith(self.suffix) and not info.is_dir():
                            yield from self.member(z, archive, info)
            except BROKEN as e:
                # Of an archive in several parts, the first tells.
                if start == 0:
                    yield (archive, None, None, None, None, None, "BadZipFile" if isinstance(e, pa.ArrowInvalid) else type(e).__name__)

    def member(self, z: zipfile.ZipFile, archive: str, info: zipfile.ZipInfo) -> Iterator[tuple]:
        if self.form == "names":
            yield (archive, info.filename, None, None, None, None, None)
            return
        try:
            if self.form == "frames":
                yield from frames(z, archive, info)
            else:
                yield (archive, info.filename, None, None, None, z.read(info).decode("utf-8-sig"), None)
        except BROKEN as e:
            yield (archive, info.filename, None, None, None, None, type(e).__name__)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=NAMES)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Path and size of the files below a folder with a suffix, by path."""
    system, root = file_systems.FileSystem.from_uri(path)
    found = system.get_file_info(file_systems.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == file_systems.FileType.File and f.path.lower().endswith(suffix))


def frames(z: zipfile.ZipFile, archive: str, info: zipfile.ZipInfo) -> Iterator[tuple]:
    """The <image> elements of a member, each as its own text; what the clip says of itself is read first, wherever it stands."""
    clip: dict[str, str | None] = {}
    with z.open(info) as file:
        for _, element in ElementTree.iterparse(file):
            if element.tag == "task":
                clip = {"source": element.findtext("source"), "width": element.findtext("original_size/width"), "height": element.findtext("original_size/height")}
                break
            if element.tag == "image":
                element.clear()
    with z.open(info) as file:
        root = None
        for event, element in ElementTree.iterparse(file, ("start", "end")):
            root = element if root is None else root
            if event == "end" and element.tag == "image":
                element.tail = None
                yield (archive, info.filename, clip.get("source"), clip.get("width"), clip.get("height"), ElementTree.tostring(element, "unicode"), None)
                root.clear()


def members(spark: SparkSession, folder: str, suffix: str, form: str = "text", part_bytes: int | None = None) -> DataFrame:
    """archive, member, text and problem of all members with a suffix of all zip files below a folder, and source, width and height of the clip where members are read as frames."""
    spark.dataSource.register(ArchiveMembers)
    reader = spark.read.format("archive_members").option("path", folder).option("suffix", suffix).option("form", form)
    return (reader if part_bytes is None else reader.option("part_bytes", part_bytes)).load()


def has_member(spark: SparkSession, folder: str, suffix: str) -> bool:
    return not members(spark, folder, suffix, "names").where("member is not null").isEmpty()


# Columns of label documents, with their types and the paths they stand under.
LABELS: Mapping[str, tuple[str, str]] = {
    "chamber_number": ("string", "$.ImageInfo['chamber-number']"),
    "video_category": ("string", "$.ImageInfo['video-category']"),
    "video_id": ("string", "$.ImageInfo.videoid"),
    "pig_classification": ("string", "$.ImageInfo['pig-classification']"),
    "pig_number": ("string", "$.ImageInfo['pig-number']"),
    "breathing_type": ("string", "$.ImageInfo['breathing-type']"),
    "date": ("string", "$.ImageInfo.date"),
    "time": ("string", "$.ImageInfo.time"),
    "weight": ("double", "$.TextInfo.weight"),
    "T": ("double", "$.SensorData.T"),
    "RH": ("double", "$.SensorData.RH"),
    "CO2": ("double", "$.SensorData.CO2"),
    "NH3": ("double", "$.SensorData.NH3"),
    "breath_rate": ("double", "$['breath-rate']"),
    "distance": ("double", "$.annotations.distance"),
    "rectal_temperature": ("double", "$.TemperatureData['rectal-temperature']"),
    "back_temperature": ("double", "$.TemperatureData['back-temperature']"),
    "neck_temperature": ("double", "$.TemperatureData['neck-temperature']"),
    "head_temperature": ("double", "$.TemperatureData['head-temperature']"),
    "evaporation": ("double", "$.evaporation"),
    "ventilation_rate": ("double", "$.FeedingAndManagementData['ventilation-rate']"),
    "feedstuff_volume": ("double", "$.FeedingAndManagementData.feedstuff_volume"),
    "watersupply": ("double", "$.FeedingAndManagementData.watersupply"),
    "pig_manure": ("double", "$['pig-manure']"),
    "sensible_heat": ("double", "$.sensibleHeat"),
    "sensible_heat_kw": ("double", "$['sensibleHeat(kW)']"),
    "latent_heat": ("double", "$.latentHeat"),
    "latent_heat_kw": ("double", "$['latentHeat(kW)']"),
}
# Folders that name a data set, parts of a path that name a split, parts of a name that name a kind.
DATASETS = ("622", "71408", "71763", "71471")
SPLITS = {"Validation": "validation", "Training": "training"}
KINDS = {"breathing": "호흡|breath", "evaporation": "증발|evap", "weight": "weight|체중"}
LABEL_FOLDER, IMAGE_FOLDER = "02.라벨링데이터", "01.원천데이터"
IMAGE_NAMES = {"증발량 데이터": "증발량 이미지", "호흡량 데이터": "호흡량 이미지"}


def first_named(choices: Mapping[str, Column], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, found in reversed(choices.items()):
        out = F.when(found, name).otherwise(out)
    return out


def split_of(path: Column) -> Column:
    return first_named({name: F.contains(path, F.lit(part)) for part, name in SPLITS.items()}, "unknown")


def kind_of(name: Column) -> Column:
    return first_named({kind: F.lower(name).rlike(pattern) for kind, pattern in KINDS.items()}, "unknown")


def dataset_of(path: Column) -> Column:
    return first_named({d: F.array_contains(F.split(path, "/"), d) for d in DATASETS}, "")


def label_time(date: Column, clock: Column) -> Column:
    """yyMMdd and HHmm, the hour with or without its zero."""
    hours = F.trim(clock)
    return F.try_to_timestamp(F.concat(F.trim(date), F.lpad(hours, F.greatest(F.length(hours), F.lit(4)), F.lit("0"))), F.lit("yyMMddHHmm")).cast("timestamp_ntz")


def label_columns(v: Column) -> list[Column]:
    """The columns of a label document (variant); values that are no numbers are null, two points give the centre."""
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    stamp = F.trim(get("$.ImageInfo.timestamp", "string"))
    points = get("$.annotations['keypoint-top']", "array<array<variant>>")
    number = lambda i, j: F.try_variant_get(points[i][j], "$", "double")
    two = F.coalesce((F.size(points) == 2) & (F.size(F.try_element_at(points, F.lit(1))) == 2) & (F.size(F.try_element_at(points, F.lit(2))) == 2), F.lit(False))
    own = [get(path, kind).alias(name) for name, (kind, path) in LABELS.items()]
    return [
        *own,
        label_time(get("$.ImageInfo.date", "string"), get("$.ImageInfo.time", "string")).alias("datetime"),
        F.when(stamp.rlike("^[0-9]+$"), stamp.try_cast("long")).alias("frame_number"),
        F.when(two, (number(0, 0) + number(1, 0)) / 2).alias("center_x"),
        F.when(two, (number(0, 1) + number(1, 1)) / 2).alias("center_y"),
    ]


def archive_labels(found: DataFrame) -> DataFrame:
    """A row for each label document of members(); texts that are no JSON object go (readers.quarantined has them)."""
    good = found.withColumn("_v", F.try_parse_json("text")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    return good.select(dataset_of(F.col("archive")).alias("dataset_key"), split_of(F.col("archive")).alias("split"), kind_of(F.col("member")).alias("kind"), F.col("archive").alias("source_zip"), F.col("member").alias("member_name"), F.concat("archive", F.lit("!"), "member").alias("label_path"), *label_columns(F.col("_v")))


def clip_columns(member: Column, source: Column) -> dict[str, Column]:
    """What a clip's name says: start, chamber, facility and pen; the source video's name counts before the folder's."""
    name = F.regexp_replace(member, r"/?[^/]*$", "")
    name = F.when(name == "", ".").otherwise(name)
    text = F.when(F.length(source) > 0, source).otherwise(name)
    part = lambda p, i=1: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    facility = part(r"P(\d+)_(\d+)_").try_cast("long")
    start = F.try_to_timestamp(F.concat(part(r"(20\d{6})_(\d{4})_(\d{4})"), part(r"(20\d{6})_(\d{4})_(\d{4})", 2)), F.lit("yyyyMMddHHmm")).cast("timestamp_ntz")
    return {
        "clip_name": name,
        "source_video": F.coalesce(source, F.lit("")),
        "clip_start_datetime": start,
        "chamber_number": F.coalesce(part(r"CH(\d+)").try_cast("long"), facility),
        "facility_number": facility,
        "pen_number": F.coalesce(part(r"P(\d+)_(\d+)_", 2).try_cast("long"), part(r"P(\d+)").try_cast("long")),
    }


def frame_annotations(found: DataFrame) -> DataFrame:
    """A row for each points or box annotation of members() read as frames: its clip, the frame and its time (the clip's start and a second for each frame), centre and span."""
    schema = (
        "_id string, _name string, _width string, _height string, "
        "points array<struct<_label: string, _occluded: string, _points: string>>, "
        "box array<struct<_label: string, _occluded: string, _xtl: string, _ytl: string, _xbr: string, _ybr: string>>"
    )
    frame = F.from_xml("text", schema, {"mode": "PERMISSIVE", "rowTag": "image"})
    size = lambda own, clip: F.floor(F.coalesce(F.nullif(F.col(own).try_cast("double"), F.lit(0.0)), F.col(clip).try_cast("double"), F.lit(0.0))).cast("long")
    rows = found.where("text is not null").withColumn("f", frame).withColumns(clip_columns(F.col("member"), F.col("source")))
    id_ = F.coalesce(F.col("f._id").try_cast("long"), F.lit(0))
    base = rows.select(
        "clip_name", "source_video", "clip_start_datetime", "chamber_number", "facility_number", "pen_number", split_of(F.col("archive")).alias("split"), F.col("archive").alias("source_zip"), F.col("member").alias("member_name"),
        id_.alias("frame_id"), F.coalesce("f._name", F.lit("")).alias("frame_name"), (F.col("clip_start_datetime") + F.make_dt_interval(secs=id_)).alias("datetime"), size("f._width", "width").alias("image_width"), size("f._height", "height").alias("image_height"), "f.points", "f.box",
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    pairs = F.transform(F.filter(F.split("a._points", ";"), lambda p: p != ""), lambda p: F.split(p, ",", 2))
    xs, ys = (F.transform("_xy", lambda t: F.try_element_at(t, F.lit(k)).try_cast("double")) for k in (1, 2))  # noqa: B023
    mean = lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), F.size(v))
    keys = [c for c in base.columns if c not in ("points", "box")]
    points = base.select(*keys, F.explode("points").alias("a")).withColumn("_xy", pairs).where(F.size("_xy") > 0).withColumns({"_x": xs, "_y": ys})
    points = points.select(*keys, F.lit("points").alias("annotation_type"), text(F.col("a._label")).alias("label"), text(F.col("a._occluded")).alias("occluded"), F.size("_xy").alias("point_count"), mean(F.col("_x")).alias("center_x"), mean(F.col("_y")).alias("center_y"), (F.array_max("_x") - F.array_min("_x")).alias("span_x"), (F.array_max("_y") - F.array_min("_y")).alias("span_y"))
    box = base.select(*keys, F.explode("box").alias("a"))
    left, top, right, bottom = (F.col(f"a._{c}").try_cast("double") for c in ("xtl", "ytl", "xbr", "ybr"))
    box = box.select(*keys, F.lit("box").alias("annotation_type"), text(F.col("a._label")).alias("label"), text(F.col("a._occluded")).alias("occluded"), F.lit(0).alias("point_count"), ((left + right) / 2).alias("center_x"), ((top + bottom) / 2).alias("center_y"), (right - left).alias("span_x"), (bottom - top).alias("span_y"))
    return points.unionByName(box)


def file_path() -> Column:
    """Path of a row's file as it is named, without the escapes of an address."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def loose_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each loose label document below a folder, with its box, the image that belongs to it, and shares of that image's area.

    The size of an image comes from the head of its PNG file.
    """
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").format("text").option("wholetext", True).load(folder).select(file_path().alias("label_path"), F.try_parse_json("value").alias("_v"))
    images = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(folder)
    edge = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    sized = images.select(file_path().alias("_image"), edge(17).alias("image_width"), edge(21).alias("image_height"))
    v = F.col("_v")
    place = F.replace("label_path", F.lit(LABEL_FOLDER), F.lit(IMAGE_FOLDER))
    for said, meant in IMAGE_NAMES.items():
        place = F.replace(place, F.lit(said), F.lit(meant))
    rows = texts.where(F.schema_of_variant("_v").startswith("OBJECT")).withColumn("_place", F.regexp_replace(place, r"\.json$", ".png"))
    joined = rows.join(sized.hint("merge"), F.col("_place") == F.col("_image"), "left")
    corner = lambda name: [F.when(F.size(F.try_variant_get(v, f"$.annotations['{name}']", "array<variant>")) == 4, F.try_variant_get(v, f"$.annotations['{name}'][{i}]", "double")) for i in range(4)]
    x, y, w, h = corner("bbox")
    _, _, free_w, free_h = corner("available-area-bbox")
    area = F.nullif(F.col("image_width") * F.col("image_height"), F.lit(0))
    out = joined.select("label_path", F.coalesce("_image", F.lit("")).alias("image_path"), "image_width", "image_height", x.alias("bbox_x"), y.alias("bbox_y"), w.alias("bbox_w"), h.alias("bbox_h"), (w * h / area).alias("bbox_area_ratio"), (free_w * free_h / area).alias("available_area_ratio"), *label_columns(v))
    centre = {"center_x": F.coalesce("center_x", F.col("bbox_x") + F.col("bbox_w") / 2), "center_y": F.coalesce("center_y", F.col("bbox_y") + F.col("bbox_h") / 2)}
    return out.withColumns(centre).select(kind_of(F.col("label_path")).alias("kind"), "label_path", "image_path", "image_width", "image_height", *LABELS, "datetime", "frame_number", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "center_x", "center_y", "bbox_area_ratio", "available_area_ratio")


#: Canonical orders of the three forms of a folder.
ORDERS = {"loose": ("chamber_number", "datetime", "frame_number", "kind"), "json": ("split", "chamber_number", "datetime", "frame_number", "kind"), "xml": ("split", "chamber_number", "datetime", "frame_id", "label")}


def folder_form(spark: SparkSession, folder: str) -> str:
    """loose, json or xml: loose label documents come first, then archives of them, then archives of annotations."""
    if listed(folder, ".json"):
        return "loose"
    return "json" if has_member(spark, folder, ".json") else "xml"


def normalised(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """The folder as one table, whatever form its documents have; a folder without any is an error."""
    form = folder_form(spark, folder)
    if form == "loose":
        return loose_labels(spark, folder), form
    if form == "json":
        return archive_labels(members(spark, folder, ".json")), form
    if not has_member(spark, folder, "annotations.xml"):
        raise FileNotFoundError(f"no label documents below {folder}")
    return frame_annotations(members(spark, folder, "annotations.xml", "frames")), form


def write_normalised(spark: SparkSession, folder: str, path: str) -> str:
    """Writes the folder's table in its canonical order, nulls last: files follow each other by ranges, rows within a file are in order."""
    rows, form = normalised(spark, folder)
    order = [F.asc_nulls_last(c) for c in ORDERS[form]]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return form
