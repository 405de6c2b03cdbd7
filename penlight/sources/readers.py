"""Readers for nested JSON, keypoint documents, CSV variants and rule files; sinks for queues and features. Archives have a module of their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penlight.operators.quality import leading_number
from penlight.operators.rules import RULES_SCHEMA
from penlight.sources import archives

# Output column -> type and the paths it may stand under, in order of preference.
LABEL_PATHS = {
    "chamber_number": ("string", ("$.ImageInfo['chamber-number']", "$.ImageInfo.chamber_number")),
    "date": ("string", ("$.ImageInfo.date",)),
    "time": ("string", ("$.ImageInfo.time",)),
    "timestamp": ("string", ("$.ImageInfo.timestamp",)),
    "pig_number": ("string", ("$.annotations['pig-number']", "$.annotations.pig_number")),
    "distance": ("double", ("$.annotations.distance",)),
    "breath_rate": ("double", ("$['breath-rate']", "$.breath_rate")),
    "barn_temperature": ("double", ("$.SensorData.T", "$.SensorData.temperature")),
    "humidity": ("double", ("$.SensorData.RH",)),
    "co2": ("double", ("$.SensorData.CO2",)),
    "nh3": ("double", ("$.SensorData.NH3",)),
    "rectal_temperature": ("double", ("$.TemperatureData['rectal-temperature']", "$.TemperatureData.rectal_temperature")),
    "feedstuff_volume": ("double", ("$.FeedingAndManagementData['feedstuff-volume']", "$.FeedingAndManagementData.feedstuff_volume")),
    "watersupply": ("double", ("$.FeedingAndManagementData['water-supply']", "$.FeedingAndManagementData.watersupply")),
}
TRACKING = ("frame", "track_id", "x", "y", "w", "h", "conf")


def files(spark: SparkSession, folder: str, pattern: str, most: int | None = None) -> DataFrame:
    """path and text of files below a folder; with `most`, the first of them by path, chosen before any is parsed."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))
    if most is None:
        return found
    chosen = found.select("source_file").orderBy("source_file").limit(most)
    return found.join(chosen.hint("merge"), "source_file", "left_semi")


def picked(variant: Column, paths: Mapping[str, tuple[str, Sequence[str]]]) -> list[Column]:
    """The first path with a value, for each column; values of the wrong type are null."""
    return [F.coalesce(*[F.try_variant_get(variant, p, kind) for p in options]).alias(name) for name, (kind, options) in paths.items()]


def labels(texts: DataFrame, paths: Mapping[str, tuple[str, Sequence[str]]] = LABEL_PATHS) -> DataFrame:
    """Typed rows of JSON label documents (source_file, text); documents that are no JSON become rows of nulls with parsed = false."""
    v = texts.withColumn("v", F.try_parse_json("text"))
    return v.select("source_file", F.col("v").isNotNull().alias("parsed"), *picked(F.col("v"), paths))


def archive_members(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """archive, member, text and problem of all members of all zip files with a suffix."""
    return archives.members(spark, folder, suffix).select("archive", "member", "text", "problem")


def quarantined(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members that parse as JSON (with column v), and those that do not (with their problem)."""
    v = members.withColumn("v", F.try_parse_json("text"))
    bad = v.where(F.col("v").isNull()).select("archive", "member", F.coalesce("problem", F.lit("not JSON")).alias("problem"))
    return v.where(F.col("v").isNotNull()).drop("problem"), bad


def keypoint_rows(good: DataFrame) -> DataFrame:
    """A row for each annotation of keypoint documents: (x, y, visible) triples as centre, span and visible points."""
    kind = "array<struct<ID:string,ACTION_NAME:string,ESTRUS:string,INJECTION:string,KEYPOINTS:array<double>>>"
    rows = good.select("archive", "member", F.try_variant_get("v", "$.IMAGE.IMAGE_FILE_NAME", "string").alias("image"), F.explode(F.from_json(F.to_json(F.variant_get("v", "$.ANNOTATION_INFO", "variant")), kind)).alias("a"))
    k = F.col("a.KEYPOINTS")
    points = F.transform(F.sequence(F.lit(1), F.greatest(F.size(k) - 2, F.lit(1)), F.lit(3)), lambda i: F.struct(F.try_element_at(k, i).alias("x"), F.try_element_at(k, i + 1).alias("y"), F.try_element_at(k, i + 2).alias("s")))
    seen = F.filter(points, lambda p: p["s"] > 0)
    axis = lambda c: F.transform("_seen", lambda p: p[c])
    mean = lambda c: F.try_divide(F.aggregate(axis(c), F.lit(0.0), lambda a, x: a + x), F.size("_seen"))
    out = rows.withColumn("_seen", seen)
    return out.select("archive", "member", "image", F.col("a.ID").alias("animal"), F.lower("a.ACTION_NAME").alias("action"), (F.col("a.ESTRUS") == "Y").cast("int").alias("estrus"), (F.col("a.INJECTION") == "Y").cast("int").alias("injection"), F.size("_seen").alias("visible_points"), mean("x").alias("center_x"), mean("y").alias("center_y"), (F.array_max(axis("x")) - F.array_min(axis("x"))).alias("span_x"), (F.array_max(axis("y")) - F.array_min(axis("y"))).alias("span_y"))


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Header CSV of a known schema, with the file's stem; values that do not fit are null."""
    rows = spark.read.csv(path, schema=schema, header=True, sep=sep, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.withColumn("source_stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1))


def csv_union(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """All files as one table; a lacking dataset_key comes from the file's name."""
    if not paths:
        raise ValueError("no input files")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [csv(spark, p, schema) for p in paths])
    key = F.coalesce("dataset_key", "source_stem") if "dataset_key" in rows.columns else F.col("source_stem")
    return rows.withColumn("dataset_key", key).drop("source_stem")


def experiment_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """CSV below folders Exp1, Exp2, ...: rows with the experiment's number."""
    rows = spark.read.option("recursiveFileLookup", True).csv(folder, schema=schema, header=True)
    return rows.withColumn("experiment", F.regexp_extract(F.col("_metadata.file_path"), r"Exp(\d+)", 1).try_cast("long"))


def promoted_header(spark: SparkSession, path: str) -> DataFrame:
    """CSV files whose first line is a title line and whose second names the columns: the rows below, with those names and the file they come from.

    Every file names its own columns; files that name others are an error, and so is a file
    that is not there. Columns without a name go, and so does a line of names further down.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=True)
    columns = raw.columns
    rows = raw.select(*[F.trim(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)], F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_place"))
    values = [f"c{i}" for i in range(len(columns))]
    # A file's first row is the first of the split that begins it. One row for each file; only distinct lines of names come here.
    heads = rows.where("_block = 0").groupBy("source_file").agg(F.min_by(F.array(*values), "_place").alias("names")).select("names").distinct().limit(2).collect()
    if not heads:
        return spark.createDataFrame([], "source_file string")
    if len(heads) > 1:
        raise ValueError(f"files name their columns differently: {heads[0]['names']} and {heads[1]['names']}")
    names = heads[0]["names"]
    is_head = F.array(*[F.coalesce(v, F.lit("")) for v in values]) == F.array(*[F.lit(n or "") for n in names])
    return rows.where(~is_head).select("source_file", *[F.col(v).alias(n) for v, n in zip(values, names) if n])


# Signs of the clinical table, and days from inoculation that are plausible.
CLINICAL_SIGNS = ("resp", "skincol", "cough", "rrate", "bc", "lam", "feces", "appet")
PLAUSIBLE_DAYS = 30


def by_animal_day(rows: DataFrame, values: Mapping[str, Column], treatment: str = "treatment") -> DataFrame:
    """pig_id, treatment, pen, dpi and values of rows with a day."""
    return rows.select(F.col("pigid").cast("string").alias("pig_id"), F.col(treatment).alias("treatment"), "pen", F.col("dpi").try_cast("double").alias("dpi"), *[v.alias(n) for n, v in values.items()]).where("dpi is not null")


def rectal_temperatures(rows: DataFrame) -> DataFrame:
    return by_animal_day(rows, {"rectal_temp_c": F.col("temp").try_cast("double")}, "trt").where("rectal_temp_c is not null")


def clinical_scores(rows: DataFrame) -> DataFrame:
    """Sum of the signs' codes, of those that have one (a cell may hold free text after its code); null without any."""
    codes = F.filter(F.array(*[leading_number(F.col(c)) for c in CLINICAL_SIGNS]), lambda x: x.isNotNull())
    score = F.when(F.size(codes) > 0, F.aggregate(codes, F.lit(0.0), lambda a, x: a + x))
    return by_animal_day(rows, {"clinical_score": score}, "trt").where(F.col("dpi").between(-PLAUSIBLE_DAYS, PLAUSIBLE_DAYS))


def activity_counts(rows: DataFrame) -> DataFrame:
    both = lambda c: F.col(f"{c}_am").try_cast("double") + F.col(f"{c}_pm").try_cast("double")
    return by_animal_day(rows, {f"{c}_count": both(c) for c in ("active", "inactive")})


def viral_loads(rows: DataFrame) -> DataFrame:
    return by_animal_day(rows, {"viral_load_log10": F.col("`log10rna/ml`").try_cast("double")}).where("viral_load_log10 is not null")


def medical_treatments(rows: DataFrame) -> DataFrame:
    return by_animal_day(rows, {"medical_treatment": F.col("Medical treatment")})


def tracking_boxes(rows: DataFrame, fps: float = 30.0) -> DataFrame:
    """Boxes of a tracker: required columns, no rows with gaps, defaults for what may lack."""
    lacking = [c for c in TRACKING if c not in rows.columns]
    if lacking:
        raise ValueError(f"tracking columns are missing: {', '.join(lacking)}")
    defaults = {"source_video": F.lit("video"), "pen_id": F.lit("pen"), "fps": F.lit(fps), "frame_width": F.lit(None).cast("double"), "frame_height": F.lit(None).cast("double")}
    return rows.dropna(subset=list(TRACKING)).withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})


def rule_config(spark: SparkSession, path: str) -> DataFrame:
    """Rule documents; rules.rule_rows makes a row of each rule."""
    return spark.read.schema(RULES_SCHEMA).option("multiLine", True).json(path)


def rule_thresholds(rules: DataFrame, defaults: Mapping[str, float | None]) -> dict[str, float | None]:
    """Thresholds by rule id, defaults for rules that the table lacks."""
    found = {r.rule_id: r.threshold for r in rules.where(F.col("rule_id").isin(list(defaults))).select("rule_id", "threshold").collect()}
    return {k: found.get(k, d) if found.get(k) is not None else d for k, d in defaults.items()}


def write_queue(queue: DataFrame, path: str) -> None:
    """A folder for each queue."""
    queue.write.mode("overwrite").partitionBy("queue").parquet(path)


def write_features(tables: Mapping[str, DataFrame], path: str) -> None:
    """Feature, window, scaler and quality tables below one folder; matrices are array columns."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
