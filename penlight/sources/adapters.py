"""Views that shape the given tables like farm inputs; one SQL text serves Spark and DuckDB.

@ntz stands for the type of time stamps without a zone. A view may build on another.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "readings": """
SELECT CASE WHEN user_id % 2 = 0 THEN 'herd_a' ELSE 'herd_b' END AS dataset_key,
       CAST(floor(user_id / 2.0) AS BIGINT) % 4 + 1 AS chamber_number, user_id AS pig_number, 'breathing' AS kind,
       CAST(date_trunc('hour', ts) AS @ntz) AS datetime,
       CASE WHEN event_type = 'purchase' THEN value END AS feedstuff_volume,
       CASE WHEN event_type = 'view' THEN value END AS watersupply,
       CASE WHEN event_type = 'signup' THEN 15 + least(value, 300) / 10 END AS barn_temperature,
       CASE WHEN event_type = 'error' THEN 400 + 3 * value END AS co2,
       CASE WHEN event_type = 'click' THEN 36 + least(value, 300) / 50 END AS rectal_temperature
FROM events""",
    "visits": """
SELECT CAST(l_linenumber % 2 AS BIGINT) AS experiment, l_suppkey AS station, concat('P', CAST(l_suppkey % 5 AS VARCHAR(9))) AS pen_id,
       l_partkey % 500 AS pig, CAST(l_shipdate AS @ntz) AS visited_at, CAST(l_shipdate AS DATE) AS date,
       l_quantity / 100 AS intake, l_tax * 1000 AS duration,
       CASE WHEN l_linenumber = 7 THEN 'FILLING' WHEN l_linenumber = 6 THEN 'GHOST' ELSE 'ok' END AS tattoo
FROM lineitem""",
    "pen_day": """
SELECT CAST(l_linenumber % 2 AS BIGINT) AS experiment, concat('P', CAST(l_suppkey % 5 AS VARCHAR(9))) AS pen_id, CAST(l_shipdate AS DATE) AS date,
       sum(l_quantity) AS feed_intake, max(l_extendedprice) / 20 AS co2_max, 15 + max(l_quantity) / 2.5 AS temperature_max,
       max(l_discount) * 400 AS ammonia_max, 40 + max(l_tax) * 500 AS humidity_max,
       (avg(l_discount) - 0.05) * 60 AS feed_zscore,
       sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS cough_sum, sum(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS diarrhea_sum,
       sum(CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END) AS panting_sum, count(*) AS health_rows
FROM lineitem GROUP BY 1, 2, 3""",
    "alerts": """
SELECT 'barn' AS track, concat('h', CAST(l_suppkey % 2 AS VARCHAR(9))) AS source_dataset, concat('c', CAST(l_suppkey % 50 AS VARCHAR(9))) AS chamber_id,
       CAST(l_shipdate AS @ntz) AS start_datetime, CAST(l_shipdate AS @ntz) + INTERVAL '24' HOUR AS end_datetime,
       l_discount * 20 AS track_score, l_tax * 10 AS management_score, l_quantity / 40 AS environment_score,
       CASE WHEN l_discount * 20 >= 1.5 THEN 'high' WHEN l_discount * 20 >= 0.8 THEN 'medium' ELSE 'normal' END AS tier,
       concat_ws(',', CASE WHEN l_returnflag = 'R' THEN 'disease' END, CASE WHEN l_tax >= 0.06 THEN 'management' END, CASE WHEN l_quantity >= 40 THEN 'environment' END) AS alert_category,
       concat_ws(',', CASE WHEN l_returnflag = 'R' THEN 'rectal_temp_high' END, CASE WHEN l_tax >= 0.06 THEN 'feed_drop' END, CASE WHEN l_quantity >= 40 THEN 'co2_high' END) AS reason,
       l_returnflag = 'R' AS model_anomaly, l_tax >= 0.06 AS rule_anomaly,
       (l_returnflag = 'R' OR l_tax >= 0.06) AS final_alert, (l_returnflag = 'R' OR l_tax >= 0.06 OR l_quantity >= 32) AS operational_alert,
       l_linenumber = 7 AS low_confidence, l_orderkey, l_linenumber
FROM lineitem""",
    "farm_events": """
SELECT CAST(o_orderkey AS VARCHAR(19)) AS event_id, 'farm' AS farm_id, concat('c', CAST(o_custkey % 50 AS VARCHAR(9))) AS chamber_id,
       CASE o_orderstatus WHEN 'F' THEN 'fever' WHEN 'O' THEN 'feed_failure' ELSE 'ventilation_failure' END AS event_type,
       CAST(o_orderdate AS @ntz) AS start_datetime, CAST(o_orderdate AS @ntz) + INTERVAL '8' HOUR AS end_datetime,
       CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS severity, o_orderstatus = 'F' AS vet_confirmed
FROM orders""",
    "points": """
SELECT l_orderkey % 9 AS facility, l_suppkey % 6 AS pen, l_orderkey AS frame_id, CAST(l_shipdate AS @ntz) AS datetime,
       CASE l_linenumber % 5 WHEN 0 THEN 'walking' WHEN 1 THEN 'feeding' WHEN 2 THEN 'lying' WHEN 3 THEN 'sitting' ELSE 'standing' END AS label,
       l_quantity * 10 AS center_x, l_discount * 1000 AS center_y, l_tax * 500 AS span_x, l_quantity AS span_y, CAST(l_linenumber AS BIGINT) AS point_count
FROM lineitem""",
    "boxes": """
SELECT concat('v', CAST(l_suppkey % 7 AS VARCHAR(9))) AS source_video, concat('p', CAST(l_suppkey % 7 AS VARCHAR(9))) AS pen_id, l_partkey % 40 AS track_id, l_orderkey AS frame,
       max(l_quantity) * 10 AS x, max(l_discount) * 1000 AS y, max(l_tax) * 500 + 5 AS w, max(l_quantity) + 5 AS h, 0.5 + min(l_discount) AS conf, 1280.0 * 1 AS frame_width, 720.0 * 1 AS frame_height
FROM lineitem GROUP BY 1, 2, 3, 4""",
    "labelled": """
SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, d.source AS experiment, d.lang AS pen_id, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "scored_windows": """
SELECT CASE WHEN label % 3 = 0 THEN 'val' ELSE 'test' END AS split, CAST(label AS BIGINT) AS pig, vec_id AS seq, abs(embedding[@first]) + abs(embedding[@second]) AS error
FROM embeddings""",
    "activity": """
SELECT user_id % 60 AS pig_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS BIGINT) AS hour, value AS movement FROM events""",
    "challenge": """
SELECT l_partkey % 200 AS pig_id, CAST(l_orderkey % 15 AS BIGINT) AS day, max(37 + l_quantity / 12) AS rectal_temperature,
       max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS clinical, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS viral
FROM lineitem GROUP BY 1, 2""",
    "reviews": """
SELECT concat('incident-', CAST(o_orderkey AS VARCHAR(19))) AS incident_id,
       CASE o_custkey % 3 WHEN 0 THEN 'disease' WHEN 1 THEN 'management' ELSE 'environment' END AS queue,
       CASE o_custkey % 4 WHEN 0 THEN 'disease: rectal_temp_high,neck_temp_high' WHEN 1 THEN 'rule: management: feed_drop' WHEN 2 THEN 'environment: co2_high nh3_high' ELSE 'water_drop,co2_high' END AS reason,
       CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'false_alarm' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'pending' ELSE 'needs_data' END END AS review_status,
       CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'no' END AS confirmed, CASE WHEN o_orderstatus = 'O' THEN ' Yes' ELSE '' END AS false_alarm,
       CASE WHEN o_custkey % 5 = 0 THEN 'y' ELSE 'n' END AS followup_required
FROM orders""",
}
NAMES = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)")


def tables_of(sql: str) -> list[str]:
    return list(dict.fromkeys(NAMES.findall(sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a given table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("@ntz", "TIMESTAMP_NTZ").replace("@first", "0").replace("@second", "1")
    parts = {t: table(spark, sf_dir, t) for t in tables_of(sql)}
    return spark.sql(NAMES.sub(lambda m: m[0][: -len(m[1])] + "{" + m[1] + "}", sql), **parts)


def rewritten(sql: str, name: str, form) -> str:
    """Every call of a function in another form; form gets the text between its parentheses."""
    at = 0
    while m := re.compile(rf"\b{name}\(").search(sql, at):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        new = form(rewritten(sql[m.end() : end - 1], name, form))
        sql, at = sql[: m.start()] + new + sql[end:], m.start() + len(new)
    return sql


def off_tie(inner: str) -> str:
    """round() a little off exact halves, which the two engines round differently; rounded() does the same."""
    value, _, places = inner.rpartition(",")
    return f"round(({value}) + 3e-9,{places})"


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 3e-9, places) for c in columns})


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names; counts become BIGINT."""
    sql = rewritten(rewritten(sql, "round", off_tie), "count_if", lambda x: f"count(CASE WHEN {x} THEN 1 END)")
    own = set(re.findall(r"(\w+) AS \(", sql))
    found: dict[str, str] = {}

    def add(text: str) -> None:
        for name in tables_of(text):
            if name in VIEWS and name not in own and name not in found:
                add(VIEWS[name])
                found[name] = VIEWS[name].replace("@ntz", "TIMESTAMP").replace("@first", "1").replace("@second", "2")

    add(sql)
    head = ", ".join(f"{n} AS ({t})" for n, t in found.items())
    rest = re.sub(r"^\s*WITH\s", "", sql)
    return f"WITH {head}{',' if head and rest != sql else ''} {rest}" if head else sql
