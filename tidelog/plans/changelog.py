"""A change log derived from the ``events`` table, deterministic at every scale.

Five events make a transaction; even users belong to ``accounts``, odd ones to
``sessions``; the user is the primary key. ``before_v`` is the value that the same key
had before, found by a window over (table, key), so the work is spread by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TX_EVENTS = 5
LSN_STEP = 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def epoch_micros(column: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone (taken as UTC)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


def raw_log(events: DataFrame) -> DataFrame:
    """Log entries as they arrive: no images of the row before."""
    eid = F.col("event_id")
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return events.select(
        eid,
        (eid * LSN_STEP).alias("lsn"),
        F.expr(f"event_id div {TX_EVENTS}").alias("txid"),
        F.when(F.col("user_id") % 2 == 0, "accounts").otherwise("sessions").alias("tbl"),
        F.col("user_id").alias("k"),
        op.alias("op"),
        F.col("value").cast("decimal(18,2)").alias("v"),
        F.col("event_type"),
        F.col("props"),
        epoch_micros("ts").alias("ts_us"),
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with their before-image, commit position, and whether the value is unavailable in the after-image."""
    log = raw_log(read(spark, sf_dir, "events"))
    by_key, by_tx = W.partitionBy("tbl", "k").orderBy("lsn"), W.partitionBy("txid")
    return log.withColumns({
        "before_v": F.lag("v").over(by_key),
        "commit_lsn": F.max("lsn").over(by_tx) + 4,
        "v_unavailable": (F.col("op") == "u") & (F.col("event_id") % 3 == 0),
    })
