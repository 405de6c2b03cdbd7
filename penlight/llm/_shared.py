"""Helpers that several operators use: the shared folder, written tables, gapless numbering."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Whole texts go to Python tasks in batches of `rows` rows where the session sets no number of its own: Spark's default of 10,000 rows of texts is held several times over, in the executor and in its workers."""
    if spark.conf.get(BATCH_ROWS, None) is None:
        spark.conf.set(BATCH_ROWS, str(rows))


def give_back() -> None:
    """Returns what a Python worker has freed to the machine: Arrow's memory, and by the system pool also that of numpy and of Python itself."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a single machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="penlight-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/penlight-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: the lineage ends there, so a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that written() made and that nothing will read again."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/penlight-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def held_out(id_col: str = "doc_id"):
    """The rows kept from learning: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def sample_limit(ids: DataFrame, id_col: str, most: int) -> int | None:
    """The largest xxhash64 among the `most` ids of smallest hash: a bound for a filter that keeps about that many rows of any table with these ids. None if there are no ids."""
    hashes = ids.select(F.xxhash64(id_col).alias("h")).orderBy("h").limit(most)
    return hashes.agg(F.max("h")).head()[0]


def with_offsets(df: DataFrame, part: str, order: list, name: str, rows: str | None = None) -> DataFrame:
    """Adds the column `name`: a running number (or the running sum of `rows` before this row) over parts in ascending order, rows ordered within a part.

    Two levels keep it parallel: totals of each part, summed up over the parts, plus a running sum in each part. `part` has at most some thousand values; only their totals meet in one task.
    """
    amount = F.lit(1) if rows is None else F.col(rows)
    totals = df.groupBy(part).agg(F.sum(amount).alias("_total"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(part).alias("_part"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    # One row for each part: bounded by the number of parts.
    return local.join(F.broadcast(starts), F.col(part) == F.col("_part")).withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_part", "_start", "_local")
