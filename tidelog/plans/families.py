"""Landed logs of MySQL, SQL Server, Oracle and MongoDB as changes, each the same for a batch and a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..encode import json as ej
from ..functions import ids
from ..functions.positions import sort_key
from ..model import COMMIT, DATA
from ..operators import pairing
from ..operators.snapshot import includes
from ..sources import logs
from ..sources.tables import ENTRIES
from ..streaming import stateful
from . import images


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def assemble(rows: DataFrame, config: Config, serial: Column, tx_id: Column, position: dict[str, Column], source: dict[str, Column], pos: dict[str, Column]) -> DataFrame:
    """Rows (op, boundary, database, schema, table, key, before, after, ts_us) with what delivery needs besides; unselected data goes, boundaries stay."""
    family, snapshot = config.source.family, F.coalesce(F.col("op") == "r", F.lit(False))
    name = F.concat_ws(".", F.coalesce("schema", "database"), "table")
    chosen = F.coalesce(F.col("op").isNotNull() & includes(name, config.source.include, config.source.exclude), F.lit(False))
    rows = rows.withColumns({"name": name, "chosen": chosen}).filter(F.col("chosen") | (F.col("boundary") != DATA))
    key = F.coalesce("key", images.declared_key(F.coalesce("after", "before"), config, F.col("name"))) if config.tables else F.col("key")
    at = ids.position_json(family, serial=serial, snapshot=snapshot, **position)
    block = ej.source_block(family, family, config.name, F.col("database"), F.col("schema"), F.col("table"), F.floor(F.col("ts_us") / 1000), F.when(snapshot, "initial"), **({"serial": serial} | source))
    # rows of one snapshot share a position: their key tells them apart
    ordinal = F.when(snapshot, F.xxhash64("key", "after")).otherwise(F.coalesce(serial, F.lit(0)))
    return rows.withColumns({
        "event_id": ids.event_id(F.lit(family), F.lit(config.name), at, F.col("name"), ordinal),
        "topic": F.when(F.col("chosen"), ej.route(config.sink.prefix or config.name, F.col("database"), F.col("schema"), F.col("table"))),
        "key": key,
        "source": block,
        "position": at,
        "transaction": ej.transaction_block(F.when(~snapshot, tx_id), none("bigint"), none("bigint")),
        "prefix": none("string"),
        "content": none("binary"),
        "pos": sort_key(family, snapshot=snapshot, serial=F.coalesce(serial, F.lit(0)), **pos),
        "source_us": F.col("ts_us"),
    })


def _with_reads(decoded: DataFrame, entries: DataFrame, is_read: Column, image: str, config: Config) -> DataFrame:
    """Snapshot rows before the log's, unless snapshots are off."""
    if config.snapshot.mode == "never":
        return decoded
    given = {"op": F.lit("r"), "boundary": F.lit(DATA), "before": none("string"), "after": F.col(image)}
    reads = entries.filter(is_read).select(*[given.get(f.name, F.col(f.name) if f.name in entries.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in decoded.schema.fields])
    return reads.unionByName(decoded)


def mysql(entries: DataFrame, config: Config) -> DataFrame:
    log = entries.filter(F.col("kind") != "read")
    rows = stateful.binlog(log) if entries.isStreaming else logs.decode_binlog(log)
    rows = _with_reads(rows.select(*entries.columns, "op", "boundary", "tx_id", "tx_gtid", "anchor", "event_serial"), entries, F.col("kind") == "read", "after", config)
    rows = rows.withColumns({"schema": none("string"), "_pos": F.when(F.col("boundary") == DATA, F.coalesce("anchor", "pos")).otherwise(F.col("pos"))})
    if config.source.origin_include or config.source.origin_exclude:
        rows = rows.filter(F.col("op") == "r").unionByName(logs.filter_origin(rows.filter(~F.coalesce(F.col("op") == "r", F.lit(False))), config.source.origin_include, config.source.origin_exclude))
    serial = F.coalesce("event_serial", F.lit(0).cast("bigint"))
    where = {"file": F.col("file"), "pos": F.col("_pos")}
    return assemble(rows, config, serial, F.col("tx_id"), where | {"gtid_set": F.col("gtid_set"), "server_id": F.col("server_id")}, where | {"server_id": F.col("server_id"), "gtid": F.col("tx_gtid")}, where)


def sqlserver(entries: DataFrame, config: Config) -> DataFrame:
    """An update's halves meet by their position; a row of operation 5 is a commit."""
    at = ["commit_lsn", "change_lsn", "database", "schema", "table"]
    packed = entries.filter(F.col("operation").between(1, 4)).select(*at, "operation", F.to_json(F.struct("image", "key", "ts_us")).alias("image"))
    if entries.isStreaming:
        paired = stateful.pair_updates(packed, at)
    else:
        paired = pairing.pair_updates(packed, at, ["image"])
        halves = F.when(F.col("orphan"), F.raise_error(F.lit("an update's after row came without its before row"))).otherwise(F.col("before.image"))
        paired = paired.select(*at, "op", "serial", halves.alias("before"), F.col("after.image").alias("after"))
    part = lambda side: F.from_json(side, "image string, key string, ts_us bigint")
    rows = paired.withColumns({"b": part("before"), "a": part("after")})
    rows = rows.select(*at, "op", F.lit(DATA).alias("boundary"), "serial", F.coalesce("a.key", "b.key").alias("key"), F.coalesce("a.ts_us", "b.ts_us").alias("ts_us"), F.col("b.image").alias("before"), F.col("a.image").alias("after"))
    commits = entries.filter(F.col("operation") == 5).select(*at, none("string").alias("op"), F.lit(COMMIT).alias("boundary"), F.lit(5).cast("bigint").alias("serial"), none("string").alias("key"), "ts_us", none("string").alias("before"), none("string").alias("after"))
    rows = _with_reads(rows.unionByName(commits), entries, F.col("operation") == 0, "image", config)
    where = {"commit_lsn": F.col("commit_lsn"), "change_lsn": F.col("change_lsn")}
    return assemble(rows, config, F.coalesce("serial", F.lit(0).cast("bigint")), F.col("commit_lsn"), where | {"database": F.col("database")}, where, where | {"database": F.col("database")})


def oracle(entries: DataFrame, config: Config) -> DataFrame:
    """Redo and undo statements to images; DDL has none."""
    decoded = logs.decode_logminer(entries.drop("after"), (-1, "", -1))
    rows = _with_reads(decoded.filter(~F.coalesce(F.col("op") == "m", F.lit(False))), entries, F.col("operation_code") == 0, "after", config)
    rows = rows.withColumn("_serial", F.when(F.col("boundary") == DATA, F.lit(1)).otherwise(2).cast("bigint"))
    where = {"scn": F.col("scn"), "commit_scn": F.col("commit_scn"), "txid": F.col("xid"), "rs_id": F.col("rs_id"), "ssn": F.col("ssn")}
    return assemble(rows, config, F.col("_serial"), F.col("xid"), where, where, {"scn": F.col("scn"), "commit_scn": F.col("commit_scn")})


def mongodb(entries: DataFrame, config: Config) -> DataFrame:
    """Change-stream events; one outside a session is its own transaction. Drops and renames have no image."""
    log = entries.filter(F.col("kind") != "read")
    op, before, after = logs.decode_document_change(F.col("kind"), F.col("full"), F.col("updated"), F.col("before"), F.col("key"))
    boundary = F.when(F.col("session").isNull() | (F.col("kind") == "commit"), COMMIT).otherwise(DATA)
    rows = log.withColumns({"op": F.when(op != "m", op), "after": after, "boundary": boundary}).withColumn("before", before)
    rows = _with_reads(rows, entries, F.col("kind") == "read", "full", config).withColumns({"schema": none("string"), "_serial": F.lit(1).cast("bigint")})
    when = {"seconds": F.col("seconds"), "increment": F.col("increment")}
    return assemble(rows, config, F.col("_serial"), F.concat(F.lit("session:"), F.col("session")), when | {"token": F.col("token")}, when | {"token": F.col("token")}, when)


FAMILIES = {"mysql": mysql, "sqlserver": sqlserver, "oracle": oracle, "mongodb": mongodb}
assert set(FAMILIES) < set(ENTRIES)
