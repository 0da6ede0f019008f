"""Registered queries: a name, a function of (spark, folder), and SQL that says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The change log of ``tidelog.plans.changelog``, as SQL.
LOG = """raw AS (
  SELECT event_id, event_id * 8 AS lsn, event_id // 5 AS txid, CASE WHEN user_id % 2 = 0 THEN 'accounts' ELSE 'sessions' END AS tbl, user_id AS k,
    CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END AS op, value::DECIMAL(18,2) AS v, event_type, props, epoch_us(ts) AS ts_us FROM events),
cl AS (
  SELECT *, lag(v) OVER (PARTITION BY tbl, k ORDER BY lsn) AS before_v, max(lsn) OVER (PARTITION BY txid) + 4 AS commit_lsn, op = 'u' AND event_id % 3 = 0 AS v_unavailable FROM raw)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(list(rows), schema)


def literal(schema: str, rows: Sequence[tuple]) -> str:
    """The same table as a DuckDB select."""
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    columns = [c.strip().split(" ") for c in schema.split(",")]

    def shown(value, kind: str) -> str:
        text = "NULL" if value is None else f"'{value.replace(chr(39), chr(39) * 2)}'" if isinstance(value, str) else str(value)
        return f"CAST({text} AS {kinds[kind]})"

    body = ", ".join("(" + ", ".join(shown(v, k) for v, (_, k) in zip(row, columns, strict=True)) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(n for n, _ in columns)})"
