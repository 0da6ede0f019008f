"""From landed envelopes or log entries to sink records, as a stream or a batch: the same expressions.

A source gives *changes*: one row a change or boundary, images and keys as JSON text. What
follows is the same for all: masking, the envelope or native form, tombstones, the binary
format, headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..encode import json as ej
from ..functions import ids
from ..functions.positions import sort_key
from ..model import COMMIT, DATA, HEARTBEAT, SNAPSHOT_COMPLETE
from ..operators.snapshot import includes
from ..sources import bridge, tables
from ..streaming.stateful import committed
from . import families, images


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _native_schema(config: Config) -> Column:
    versions = {t.name: t.version for t in config.tables}
    version = F.coalesce(*[F.when(F.col("name") == n, F.lit(str(v))) for n, v in versions.items()], F.lit("1"))
    return ej.json_object([("name", ej.json_string(F.col("name"))), ("version", version)])


def finish(changes: DataFrame, config: Config) -> DataFrame:
    """Changes to sink columns (topic, key, value, headers), and boundary, pos, source_us.

    ``changes``: topic (null: nothing to deliver), name, database, schema, table, op, key, before, after, source,
    position, transaction, prefix, content (of messages), event_id, boundary, pos, source_us.
    """
    place = [F.col(c) for c in ("database", "schema", "table")]
    hidden = {c: images.masked(F.col(c), config, *place) for c in ("before", "after", "key")} if config.columns else {}
    rows = changes.withColumns(hidden)
    observed = F.floor(F.col("source_us") / 1000)
    if config.format.kind == "native":
        value = ej.native(F.col("event_id"), F.col("source"), F.col("position"), F.col("transaction"), F.col("op"), F.col("before"), F.col("after"), _native_schema(config), observed, observed)
    else:
        whole = ej.envelope(F.col("before"), F.col("after"), F.col("source"), F.col("op"), observed, F.col("transaction"))
        value = F.when(F.col("prefix").isNotNull(), ej.message_envelope(F.col("source"), F.col("prefix"), F.col("content"), observed, F.col("transaction"))).otherwise(whole)
    out = rows.withColumn("value", F.when(F.col("topic").isNotNull(), value))
    out = ej.with_tombstones(out, config.format.tombstones and config.format.kind != "native")
    if config.format.kind in ("json_schema", "avro", "protobuf"):
        key, value = images.encoded(F.when(F.col("topic").isNotNull(), F.col("key")), F.col("value"), config, F.col("name"))
        out = out.withColumns({"key": key, "value": value})
    headers = F.create_map(F.lit("tidelog.event.id"), F.col("event_id"), F.lit("tidelog.tombstone"), F.col("is_tombstone").cast("string"))
    return out.select("topic", "key", "value", headers.alias("headers"), "boundary", "pos", "source_us")


def records(docs: DataFrame, config: Config) -> DataFrame:
    """Envelope documents to sink records. A declared table's key is made of its key columns, any other's of its column ``id``."""
    rows = bridge.decode(docs, record_id=F.col("record_id") if "record_id" in docs.columns else None)
    rows = rows.withColumn("name", F.concat_ws(".", F.coalesce("schema", "database"), "table"))
    chosen = F.col("op").isNotNull() & includes(F.col("name"), config.source.include, config.source.exclude)
    if config.snapshot.mode == "never":
        chosen = chosen & ~F.col("is_snapshot")
    image = F.coalesce("after", "before")
    id_field = F.get_json_object(F.when(F.col("op") != "m", image), "$.id")
    by_id = F.when(id_field.isNotNull(), ej.json_object([("id", id_field)]))
    known = [t.name for t in config.tables]
    key = F.when(F.col("name").isin(*known), images.declared_key(F.when(F.col("op") != "m", image), config, F.col("name"))).otherwise(by_id) if known else by_id
    source = ej.source_block(
        "bridge", "bridge", config.name, F.col("database"), F.col("schema"), F.col("table"), F.floor(F.col("source_us") / 1000), F.when(F.col("is_snapshot"), "initial"), offset=F.lit("{}"), record_id=F.col("record_id"), serial=F.lit(1)
    )
    position = ej.json_object([("type", F.lit('"bridge"')), ("record_id", ej.json_string(F.col("record_id"))), ("event_serial", F.lit("1")), ("snapshot", ej.json_boolean(F.col("is_snapshot")))])
    out = rows.withColumns({
        "topic": F.when(chosen, ej.route(config.sink.prefix or config.name, F.col("database"), F.col("schema"), F.col("table"))),
        "key": key,
        "after": F.when(F.col("op") != "m", F.col("after")),
        "source": source,
        "position": position,
        "transaction": ej.transaction_block(F.col("tx_id"), none("bigint"), none("bigint")),
        "prefix": none("string"),
        "content": none("binary"),
        "pos": sort_key("bridge", snapshot=F.col("is_snapshot"), serial=F.coalesce("source_us", F.lit(0))),
    })
    return finish(out.filter(chosen | (F.col("boundary") != HEARTBEAT)), config)


def bridge_records(spark: SparkSession, config: Config) -> DataFrame:
    return records(bridge.read_stream(spark, config.source.path), config)


def log_records(entries: DataFrame, config: Config) -> DataFrame:
    """Landed PostgreSQL log entries (and snapshot rows as ``read``) to sink records, the same for a batch and a stream.

    A transaction is delivered when its commit has been seen, and never when it was rolled back; ordinals come with the entries.
    Commits and filtered messages have no topic: they only move the position on.
    """
    kind = F.col("kind")
    if config.snapshot.mode == "never":
        entries = entries.filter(~kind.isin("read", "snapshot_complete"))
    codes = {"read": "r", "incremental": "r", "insert": "c", "update": "u", "delete": "d", "truncate": "t", "message": "m"}
    op = F.coalesce(*[F.when(kind == k, c) for k, c in codes.items()])
    commit = kind.isin("commit", "stream_commit", "commit_prepared") | ((kind == "message") & ~F.coalesce("transactional", F.lit(True)))
    boundary = F.when(kind == "snapshot_complete", SNAPSHOT_COMPLETE).when(commit, COMMIT).otherwise(DATA)
    prefix_ok = includes(F.col("prefix"), config.source.message_include, config.source.message_exclude)
    name = F.concat_ws(".", "schema", "table")
    chosen = F.when(kind == "message", F.lit(config.source.messages) & prefix_ok).otherwise(includes(name, config.source.include, config.source.exclude) & op.isNotNull())
    rows = committed(entries).withColumns({"op": op, "boundary": boundary, "chosen": F.coalesce(chosen, F.lit(False)), "name": name, "database": F.lit(config.source.database)})
    rows = rows.filter(F.col("chosen") | (F.col("boundary") != DATA))
    snapshot = F.coalesce(F.col("op") == "r", F.lit(False))
    serial = F.coalesce("serial", F.lit(1))
    position = ids.position_json("postgresql", lsn=F.col("lsn"), commit_lsn=F.col("commit_lsn"), txid=F.col("txid"), xmin=F.col("xmin"), serial=serial, snapshot=snapshot)
    observed = F.floor(F.col("ts_us") / 1000)
    source = ej.source_block(
        "postgresql", "postgresql", config.name, F.col("database"), F.col("schema"), F.col("table"), observed, F.when(F.col("kind") == "incremental", "incremental").when(snapshot, "initial"), commit_lsn=F.col("commit_lsn"), lsn=F.col("lsn"), txid=F.col("txid"), xmin=F.coalesce("xmin", none("bigint"))
    )
    prefix = config.sink.prefix or config.name
    is_message = F.col("op") == "m"
    # rows of one snapshot share a position: their key tells them apart
    ordinal = F.when(snapshot, F.xxhash64("key")).otherwise(serial)
    out = rows.withColumns({
        "event_id": ids.event_id(F.lit("postgresql"), F.lit(config.name), position, name, ordinal),
        "topic": F.when(F.col("chosen"), F.when(is_message, ej.message_route(prefix)).otherwise(ej.route(prefix, F.col("database"), F.col("schema"), F.col("table")))),
        "source": source,
        "position": position,
        "transaction": ej.transaction_block(F.when(~snapshot, F.col("txid").cast("string")), F.col("total_order"), F.col("collection_order")),
        "prefix": F.when(is_message, F.col("prefix")),
        "pos": sort_key("postgresql", lsn=F.col("lsn"), serial=serial, snapshot=snapshot),
        "source_us": F.col("ts_us"),
    })
    return finish(out, config)


def family_records(entries: DataFrame, config: Config) -> DataFrame:
    """Landed entries of a family (their columns: ``sources.tables.ENTRIES``) to sink records."""
    if config.source.family == "postgresql":
        return log_records(entries, config)
    return finish(families.FAMILIES[config.source.family](entries, config), config)


def source_records(spark: SparkSession, config: Config) -> DataFrame:
    """The stream of a configured source."""
    if config.source.family == "bridge":
        return bridge_records(spark, config)
    return family_records(tables.read_log(spark, config.source.path, family=config.source.family), config)
