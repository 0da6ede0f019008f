"""Heartbeats: records that move a position on while no data comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..encode import json as ej
from ..model import HEARTBEAT


def heartbeats(positions: DataFrame, prefix: str, heartbeat_prefix: str | None, name: str | None = None, observed_us: str = "observed_us") -> DataFrame:
    """Heartbeat records at safe positions (the last commits): topic, key, value, boundary."""
    return positions.withColumns({
        "topic": F.lit(ej.heartbeat_route(prefix, heartbeat_prefix, name)),
        "key": ej.json_object([("serverName", ej.json_string(F.lit(prefix)))]),
        "value": ej.heartbeat_envelope(F.floor(F.col(observed_us) / 1000)),
        "boundary": F.lit(HEARTBEAT),
    })


def timer(spark: SparkSession, interval_s: int = 10) -> DataFrame:
    """A stream with one row an interval, for heartbeats of an idle source."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.filter(F.col("value") % interval_s == 0).select(F.unix_micros("timestamp").alias("observed_us"))
