"""Continuous forms of the batch operators, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from penlight.functions.tables import exists
from penlight.operators import review, rules


def tumbling(stream: DataFrame, features: Sequence[str], keys: Sequence[str], width: str = "10 minutes", late: str = "30 minutes", time: str = "datetime") -> DataFrame:
    """Means over time bins; rows later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("w")).agg(*[F.avg(c).alias(c) for c in features], F.count("*").alias("rows")).select(*keys, F.col("w.start").alias(time), *features, "rows")


def sliding(stream: DataFrame, value: str, keys: Sequence[str], width: str = "3 days", step: str = "1 hour", late: str = "1 hour", time: str = "datetime") -> DataFrame:
    """Mean and std over the last days, every hour."""
    w = stream.withWatermark(time, late).groupBy(*keys, F.window(time, width, step).alias("w"))
    return w.agg(F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_std")).select(*keys, F.col("w.end").alias(time), f"{value}_mean", f"{value}_std")


INCIDENT = "start_us long, end_us long, window_count long, max_track_score double, max_management_score double, max_environment_score double"
SCORES = ("track_score", "management_score", "environment_score")


class OpenIncidents(StatefulProcessor):
    """The incidents of one key that a coming window may still join; an incident is emitted once the watermark is past its end by more than the gap.

    Windows are joined whatever order they come in: two are of one incident if neither
    begins more than the gap after the other ends, and a window may join several incidents.
    Times are microseconds.
    """

    gap = 0
    keys: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", INCIDENT)

    def held(self) -> list[tuple]:
        return [tuple(x) for x in self.open.get()] if self.open.exists() else []

    def keep(self, found: list[tuple]) -> None:
        if found:
            self.open.put(found)
        else:
            self.open.clear()
        set_before = set(self.handle.listTimers())
        for due in {(x[1] + self.gap) // 1000 + 1 for x in found} - set_before:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.held()
        for batch in rows:
            for start, end, *scores in batch[["start_us", "end_us", *SCORES]].itertuples(index=False):
                found.append((int(start), int(end), 1, *(None if pd.isna(s) else float(s) for s in scores)))
            found = merged_incidents(found, self.gap)
        self.keep(found)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        found = self.held()
        done = [x for x in found if x[1] + self.gap <= past]
        if done:
            self.keep([x for x in found if x not in done])
            out = pd.DataFrame(done, columns=[x.split()[0] for x in INCIDENT.split(", ")])
            for i, (name, value) in enumerate(zip(self.keys, key)):
                out.insert(i, name, pd.Series([value] * len(out), dtype=object))
            yield out

    def close(self) -> None:
        pass


def joined_incidents(a: tuple, b: tuple) -> tuple:
    most = (x if y is None else y if x is None else max(x, y) for x, y in zip(a[3:], b[3:]))
    return (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], *most)


def merged_incidents(found: list[tuple], gap: int) -> list[tuple]:
    out: list[tuple] = []
    for one in sorted(found, key=lambda x: x[:2]):
        if out and one[0] <= out[-1][1] + gap:
            out[-1] = joined_incidents(out[-1], one)
        else:
            out.append(one)
    return out


def sessions(stream: DataFrame, keys: Sequence[str] = ("queue", "chamber_id", "reason"), gap_hours: int = 6, late: str = "1 hour") -> DataFrame:
    """Incidents of alert windows of any length: a window joins an incident unless it begins more than the gap after all ends before it.

    Append mode: an incident comes out once, when no window in time can join it any more.
    Windows without a start or an end, and windows that end before they begin, are left out.
    """
    rows = stream.withWatermark("start_datetime", late).where("start_datetime is not null and end_datetime >= start_datetime")
    known = rows.select(*[F.col(k).cast("string").alias(k) for k in keys], "start_datetime", *[F.unix_micros(F.col(f"{c}_datetime").cast("timestamp")).alias(f"{c}_us") for c in ("start", "end")], *[F.col(c).cast("double").alias(c) for c in SCORES])
    processor = type("Incidents", (OpenIncidents,), {"gap": gap_hours * 3_600_000_000, "keys": tuple(keys)})()
    found = known.groupBy(*keys).transformWithStateInPandas(processor, ", ".join(f"{k} string" for k in keys) + ", " + INCIDENT, "append", "eventTime")
    return found.select(*keys, *[F.timestamp_micros(f"{c}_us").alias(f"incident_{c}_datetime") for c in ("start", "end")], "window_count", *[f"max_{c}" for c in SCORES])


def scored(stream: DataFrame, rule_set: Sequence[Mapping], keys: Sequence[str]) -> DataFrame:
    """Rules on arriving windows; stateless."""
    return rules.evaluate(stream, rule_set, keys)


def lead_matches(events: DataFrame, alerts: DataFrame, hours: int = 72, late: str = "2 hours") -> DataFrame:
    """Events with the alerts of their chamber at most `hours` before; an event without one comes with nulls.

    Both sides keep state for as long as a match may come: an event without alerts comes out
    when the watermark has passed it.
    """
    e = events.withWatermark("event_start", late).select(F.col("chamber_id").alias("e_chamber"), "event_id", "event_start")
    a = alerts.withWatermark("alert_start", late).select("chamber_id", "alert_start", "track_score")
    return e.join(a, F.expr(f"e_chamber = chamber_id AND alert_start <= event_start AND alert_start >= event_start - INTERVAL '{hours}' HOUR"), "left_outer")


def lead_outcomes(events: DataFrame, alerts: DataFrame, horizons: Sequence[int] = (24, 48, 72), late: str = "2 hours") -> DataFrame:
    """One row for each event, alerts or not: how many led it, the first one, the highest score, and whether it was caught within each horizon."""
    matched = lead_matches(events, alerts, max(horizons), late)
    lead = (F.unix_micros("event_start") - F.unix_micros("alert_start")) / 3.6e9
    found = matched.groupBy("event_id", "e_chamber", "event_start").agg(
        F.count("alert_start").alias("lead_alert_count"), F.min("alert_start").alias("first_alert_start"), F.max(lead).alias("first_lead_hours"), F.max("track_score").alias("max_track_score"),
        *[F.coalesce(F.bool_or(lead <= h), F.lit(False)).alias(f"caught_within_{h}h") for h in horizons],
    )
    return found.withColumnRenamed("e_chamber", "chamber_id")


class RunConfirmation(StatefulProcessor):
    """Emits the rows of a run of flags once it reaches `required`, the ones before it included."""

    required = 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("at")
        held = [int(x) for x in self.run.get()[0].split(",") if x] if self.run.exists() else []
        out = []
        for at, on in zip(batch["at"], batch["flag"]):
            if not on:
                held = []
                continue
            # A run that is out already is kept as the single mark -1.
            if held == [-1]:
                out.append(int(at))
            elif len(held) + 1 >= self.required:
                out += [*held, int(at)]
                held = [-1]
            else:
                held.append(int(at))
        self.run.update((",".join(map(str, held)),))
        yield pd.DataFrame({"chamber_id": pd.Series([key[0]] * len(out), dtype=object), "at": pd.Series(out, dtype="int64")})

    def close(self) -> None:
        pass


def confirmed(stream: DataFrame, required: int = 3) -> DataFrame:
    """chamber_id and at of confirmed flags; stream: chamber_id string, at long, flag boolean, in order for each chamber."""
    processor = type("Confirmation", (RunConfirmation,), {"required": required})()
    return stream.groupBy("chamber_id").transformWithStateInPandas(processor, "chamber_id string, at long", "append", "none")


#: Parts of a review log; a batch rewrites the parts that its decisions touch.
PARTS = 32


def part_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def versions(spark: SparkSession, path: str, no: int) -> dict[int, int]:
    """Of every part that has rows the batch that wrote it last, as of batch `no`; -1 is the log at the start."""
    return {r["part"]: r["version"] for r in spark.read.parquet(f"{path}/manifest/batch={no}").where("part >= 0").collect()}


def write_versions(spark: SparkSession, path: str, no: int, held: Mapping[int, int]) -> None:
    # The row of part -1 stands for the batch itself, also where the log is empty.
    rows = spark.createDataFrame([(-1, no), *sorted(held.items())], "part int, version int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={no}")


def read_parts(spark: SparkSession, path: str, held: Mapping[int, int]) -> DataFrame:
    places = [f"{path}/data/version={v}/part={p}" for p, v in sorted(held.items())]
    schema = spark.read.parquet(f"{path}/schema").schema
    return (spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)).select(*schema.names)


def start_review_log(log: DataFrame, path: str, key: str = "incident_id") -> None:
    """Lays the log down in parts, unless it is there."""
    spark = log.sparkSession
    if exists(spark, f"{path}/manifest/batch=-1/_SUCCESS"):
        return
    log.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    log.withColumn("part", part_of(key)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/version=-1")
    parts = log.select(part_of(key).alias("part")).distinct().collect()
    write_versions(spark, path, -1, {r["part"]: -1 for r in parts})


def review_log(spark: SparkSession, path: str, no: int | None = None) -> DataFrame:
    """The log as of a batch, the last one if not given."""
    if no is None:
        no = spark.read.parquet(f"{path}/manifest").agg(F.max("batch")).head()[0]
    return read_parts(spark, path, versions(spark, path, no))


def apply_decisions(batch: DataFrame, no: int, path: str, key: str = "incident_id") -> None:
    """One batch of decisions on the log as of the batch before. Only parts with decided incidents are written, under the batch's number; its list of parts comes last and commits it. A batch that is committed changes nothing when it comes again."""
    spark = batch.sparkSession
    if exists(spark, f"{path}/manifest/batch={no}/_SUCCESS"):
        return
    held = versions(spark, path, no - 1)
    # At most PARTS numbers.
    touched = {r["part"] for r in batch.select(part_of(key).alias("part")).distinct().collect()} & set(held)
    if touched:
        log = read_parts(spark, path, {p: held[p] for p in touched})
        review.decided(log, batch).withColumn("part", part_of(key)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/version={no}")
    now = held | {p: no for p in touched}
    review.summary(read_parts(spark, path, now)).withColumn("snapshot_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}/history/batch={no}")
    write_versions(spark, path, no, now)


def review_upserts(decisions: DataFrame, log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Applies decisions to a review log as they come; review_log() reads it, {path}/history has a summary for each batch."""
    start_review_log(log, path)
    return decisions.writeStream.foreachBatch(lambda batch, no: apply_decisions(batch, no, path)).option("checkpointLocation", checkpoint).start()
