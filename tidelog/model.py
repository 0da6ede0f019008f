"""Names shared by all parts of the engine: operations, boundaries, defaults."""

from __future__ import annotations

from pyspark.sql import types as T

#: Operation names and their wire codes.
OP_CODES = {"read": "r", "create": "c", "update": "u", "delete": "d", "truncate": "t", "message": "m"}
OP_NAMES = {code: name for name, code in OP_CODES.items()}

DATA, COMMIT, SNAPSHOT_COMPLETE, HEARTBEAT = "data", "transaction_commit", "snapshot_complete", "heartbeat"
BOUNDARIES = (DATA, COMMIT, SNAPSHOT_COMPLETE, HEARTBEAT)

VERSION = "0.1.0"
#: Stands in an envelope for a column that a row image does not hold.
UNAVAILABLE = "__tidelog_unavailable"

#: Defaults of the record pipeline.
DEFAULTS = {
    "channel_capacity": 2_048,
    "max_batch_size": 512,
    "flush_interval_ms": 100,
    "shutdown_timeout_ms": 30_000,
    "max_retries": 10,
    "retry_initial_ms": 300,
    "retry_max_ms": 10_000,
    "snapshot_fetch_size": 10_000,
    "chunk_size": 1_024,
    "stream_fetch_size": 10_240,
    "poll_interval_ms": 500,
    "delivery_timeout_ms": 30_000,
    "registry_cache": 1_000,
    "completed_signals": 1_024,
}

#: u64 coordinates; Spark has no unsigned 64-bit integer.
U64 = T.DecimalType(20, 0)

#: One change, without its table-typed row images.
CHANGE = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("connector", T.StringType()),
    T.StructField("connector_name", T.StringType()),
    T.StructField("database", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("boundary", T.StringType()),
    T.StructField("is_snapshot", T.BooleanType()),
    T.StructField("snapshot_kind", T.StringType()),
    T.StructField("pos", T.StructType([T.StructField("major", U64), T.StructField("minor", T.StringType()), T.StructField("is_stream", T.IntegerType()), T.StructField("serial", T.LongType())])),
    T.StructField("pos_raw", T.StringType()),
    T.StructField("tx", T.StructType([T.StructField("id", T.StringType()), T.StructField("total_order", T.LongType()), T.StructField("collection_order", T.LongType())])),
    T.StructField("unavailable_before", T.ArrayType(T.StringType())),
    T.StructField("unavailable_after", T.ArrayType(T.StringType())),
    T.StructField("schema_name", T.StringType()),
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("source_ts", T.TimestampType()),
    T.StructField("observed_ts", T.TimestampType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
])
