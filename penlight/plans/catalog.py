"""Registered queries of the livestock operators and their DuckDB oracles."""

from __future__ import annotations

from penlight.plans import alerting, comparisons, extras, pens, sensor, tracks

QUERIES = {**sensor.QUERIES, **alerting.QUERIES, **pens.QUERIES, **tracks.QUERIES, **extras.QUERIES, **comparisons.QUERIES}
ORACLE_SQL = {**sensor.ORACLE_SQL, **alerting.ORACLE_SQL, **pens.ORACLE_SQL, **tracks.ORACLE_SQL, **extras.ORACLE_SQL, **comparisons.ORACLE_SQL}
flagship = sensor.flagship
