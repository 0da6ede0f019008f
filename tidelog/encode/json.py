"""JSON envelopes, keys, routes, tombstones.

Images are structs of text already rendered for JSON (a number, a quoted string, a
placeholder), because a column may hold a number in one row and the placeholder in the
next; objects are put together from these texts in the order of the schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import derived_id
from ..model import OP_NAMES, VERSION

NULL = "null"


def json_string(c: Column) -> Column:
    """A JSON string, or ``null``."""
    listed = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNull(), NULL).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def json_number(c: Column) -> Column:
    """A JSON number; ``null`` for null, NaN and infinities."""
    return F.coalesce(F.when(~c.cast("string").isin("NaN", "Infinity", "-Infinity"), c.cast("string")), F.lit(NULL))


def json_boolean(c: Column) -> Column:
    return F.coalesce(F.when(c, "true").when(~c, "false"), F.lit(NULL))


def json_object(fields: Sequence[tuple[str, Column]]) -> Column:
    """An object from rendered values, in order."""
    parts: list[Column] = []
    for i, (name, value) in enumerate(fields):
        quoted = name.replace("\\", "\\\\").replace('"', '\\"')
        parts += [F.lit(("{" if i == 0 else ",") + f'"{quoted}":'), value]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def or_placeholder(rendered: Column, unavailable: Column, placeholder: str) -> Column:
    return F.when(unavailable, json_string(F.lit(placeholder))).otherwise(rendered)


def source_block(family: str, connector: str, name: str, db: Column, schema: Column, table: Column, ts_ms: Column, snapshot: Column, **c: Column) -> Column:
    """The source object: eight common fields, then those of the family. ``snapshot``: null, initial or incremental."""
    shown = F.when(snapshot.isNull(), "false").when(snapshot == "incremental", "incremental").otherwise("true")
    fields = [("version", json_string(F.lit(VERSION))), ("connector", json_string(F.lit(connector))), ("name", json_string(F.lit(name))), ("ts_ms", json_number(ts_ms)), ("snapshot", json_string(shown)), ("db", json_string(db)), ("schema", json_string(schema)), ("table", json_string(table))]
    number, text = json_number, json_string
    if family == "postgresql":
        sequence = F.concat(F.lit('["'), F.coalesce(c["commit_lsn"], c["lsn"]).cast("string"), F.lit('","'), c["lsn"].cast("string"), F.lit('"]'))
        fields += [("sequence", text(sequence)), ("txId", number(c["txid"])), ("lsn", number(c["lsn"])), ("xmin", number(c["xmin"]))]
    elif family == "mysql":
        fields += [("server_id", number(c["server_id"])), ("gtid", text(c["gtid"])), ("file", text(c["file"])), ("pos", number(c["pos"])), ("row", number(c["serial"])), ("thread", F.lit(NULL)), ("query", F.lit(NULL))]
    elif family == "sqlserver":
        fields += [("change_lsn", text(c["change_lsn"])), ("commit_lsn", text(c["commit_lsn"])), ("event_serial_no", number(c["serial"]))]
    elif family == "oracle":
        fields += [("scn", text(c["scn"])), ("commit_scn", text(c["commit_scn"])), ("txId", text(c["txid"])), ("rs_id", text(c["rs_id"])), ("ssn", number(c["ssn"])), ("event_serial_no", number(c["serial"]))]
    elif family == "mongodb":
        fields += [("resume_token", text(c["token"])), ("cluster_time_seconds", number(c["seconds"])), ("cluster_time_increment", number(c["increment"])), ("event_serial_no", number(c["serial"]))]
    elif family == "bridge":
        fields += [("source_offset", text(c["offset"])), ("record_id", text(c["record_id"])), ("event_serial_no", number(c["serial"]))]
    else:
        raise ValueError(f"unknown family: {family}")
    return json_object(fields)


def transaction_block(tx_id: Column, total: Column, collection: Column) -> Column:
    return F.when(tx_id.isNull(), NULL).otherwise(json_object([("id", json_string(tx_id)), ("total_order", json_number(total)), ("data_collection_order", json_number(collection))]))


def envelope(before: Column, after: Column, source: Column, op: Column, observed_ms: Column, transaction: Column) -> Column:
    """The change envelope; images are rendered objects or null."""
    return json_object([("before", F.coalesce(before, F.lit(NULL))), ("after", F.coalesce(after, F.lit(NULL))), ("source", source), ("op", json_string(op)), ("ts_ms", json_number(observed_ms)), ("transaction", transaction)])


def op_name(code: Column) -> Column:
    return F.coalesce(*[F.when(code == c, n) for c, n in OP_NAMES.items()])


def native(event_id: Column, source: Column, position: Column, transaction: Column, code: Column, before: Column, after: Column, schema: Column, source_ms: Column, observed_ms: Column) -> Column:
    """The engine's own JSON form: operation by name, no tombstones."""
    return json_object([
        ("specversion", F.lit('"1.0"')), ("id", json_string(event_id)), ("source", source), ("position", position), ("transaction", transaction), ("op", json_string(op_name(code))),
        ("before", F.coalesce(before, F.lit(NULL))), ("after", F.coalesce(after, F.lit(NULL))), ("schema", schema), ("source_time", json_number(source_ms)), ("observed_time", json_number(observed_ms)),
    ])


def heartbeat_envelope(observed_ms: Column) -> Column:
    return json_object([("ts_ms", json_number(observed_ms))])


def message_envelope(source: Column, prefix: Column, content: Column, observed_ms: Column, transaction: Column) -> Column:
    """A logical message: prefix and base64 content."""
    message = json_object([("prefix", json_string(prefix)), ("content", json_string(F.base64(content)))])
    return json_object([("op", F.lit('"m"')), ("ts_ms", json_number(observed_ms)), ("source", source), ("transaction", transaction), ("message", message)])


def route(prefix: str, db: Column, schema: Column, table: Column) -> Column:
    """``prefix.db[.schema].table``."""
    return F.concat_ws(".", F.lit(prefix), db, schema, table)


def message_route(prefix: str) -> Column:
    return F.lit(f"{prefix}.message")


def heartbeat_route(prefix: str, heartbeat_prefix: str | None, name: str | None) -> str:
    return name if name else f"{heartbeat_prefix}.{prefix}"


def with_tombstones(encoded: DataFrame, enabled: bool = True, event_id: str = "event_id", op: str = "op", key: str = "key", value: str = "value") -> DataFrame:
    """A delete with a key is followed by a record of the same key without a value, under an id derived from its own."""
    if not enabled:
        return encoded.withColumn("is_tombstone", F.lit(False))
    twice = F.when((F.col(op) == "d") & F.col(key).isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    out = encoded.withColumn("is_tombstone", F.explode(twice))
    return out.withColumns({value: F.when(~F.col("is_tombstone"), F.col(value)), event_id: F.when(F.col("is_tombstone"), derived_id(F.col(event_id), "tombstone")).otherwise(F.col(event_id))})
