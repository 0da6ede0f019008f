"""Deterministic event identifiers: the same change has the same id in every delivery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"


def _bytes(c: Column | str) -> Column:
    return F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8")


def be64(c: Column) -> Column:
    """A long as 8 big-endian bytes."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 16, "0"))


def event_id(connector: Column, partition: Column, position_json: Column, collection: Column, ordinal: Column) -> Column:
    sep = F.lit(bytearray(b"\x00"))
    return F.sha2(F.concat(_bytes(connector), sep, _bytes(partition), sep, _bytes(position_json), sep, _bytes(collection), be64(ordinal)), 256)


def derived_id(parent: Column, discriminator: str) -> Column:
    """The id of a record made from another one, such as a tombstone."""
    return F.sha2(F.concat(_bytes(parent), F.lit(bytearray(b"\x00")), _bytes(F.lit(discriminator))), 256)


def bridge_id(connector: Column, record_id: Column) -> Column:
    return F.sha2(F.concat(_bytes(connector), F.lit(bytearray(b"\x00")), _bytes(record_id)), 256)


def position_json(family: str, **c: Column) -> Column:
    """The text of a position that goes into ids: fields in a fixed order, optional ones as null or left out, by family."""

    def num(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit("null"))

    def text(x: Column) -> Column:
        return F.when(x.isNull(), "null").otherwise(F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2))

    def flag(x: Column) -> Column:
        return F.when(x, "true").otherwise("false")

    def optional(name: str, x: Column | None, shown=num) -> list[Column]:
        return [] if x is None else [F.when(x.isNull(), "").otherwise(F.concat(F.lit(f',"{name}":'), shown(x)))]

    lit, none = F.lit, F.lit(None).cast("string")
    if family == "postgresql":
        parts = [lit('{"type":"postgresql","lsn":'), num(c["lsn"]), lit(',"commit_lsn":'), num(c.get("commit_lsn", none)), lit(',"transaction_id":'), num(c.get("txid", none)), *optional("xmin", c.get("xmin"))]
    elif family == "mysql":
        parts = [lit('{"type":"mysql","binlog_filename":'), text(c["file"]), lit(',"binlog_position":'), num(c["pos"]), lit(',"gtid_set":'), text(c.get("gtid_set", none)), lit(',"server_id":'), num(c["server_id"])]
    elif family == "sqlserver":
        parts = [lit('{"type":"sqlserver","database":'), text(c["database"]), lit(',"commit_lsn":'), text(c["commit_lsn"]), lit(',"change_lsn":'), text(c["change_lsn"])]
    elif family == "oracle":
        parts = [lit('{"type":"oracle","scn":'), num(c["scn"]), lit(',"commit_scn":'), num(c.get("commit_scn", none)), lit(',"transaction_id":'), text(c.get("txid", none)), *optional("rs_id", c.get("rs_id"), text), *optional("ssn", c.get("ssn"))]
    elif family == "mongodb":
        parts = [lit('{"type":"mongodb"'), *optional("resume_token", c.get("token"), text), *optional("cluster_time_seconds", c.get("seconds")), *optional("cluster_time_increment", c.get("increment"))]
    else:
        raise ValueError(f"no position text for {family}")
    return F.concat(*parts, lit(',"event_serial":'), num(c["serial"]), lit(',"snapshot":'), flag(c["snapshot"]), lit("}"))
