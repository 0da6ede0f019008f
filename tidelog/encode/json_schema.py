"""JSON Schema (draft 7) of what the JSON encoders write.

A document's shape is stated as text, ``name type, name type?``: the members in order, a
question mark on those that may be null. ``members`` renders such a line; columns of a table
are rendered from their wire kind, and everything else is put together from these two.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..model import OP_CODES
from ..operators.schema_history import Field, Table
from .kinds import kind

#: The schema dialect, and the members of the parts of an envelope.
DRAFT = "http://json-schema.org/draft-07/schema#"
SOURCE = "version string, connector string, name string, ts_ms integer?, snapshot string, db string, schema string?, table string?"
SOURCE_OF = {
    "postgresql": "sequence string, txId integer?, lsn integer, xmin integer?",
    "mysql": "server_id integer, gtid string?, file string, pos integer, row integer, thread integer?, query string?",
    "sqlserver": "change_lsn string, commit_lsn string, event_serial_no integer",
    "oracle": "scn string, commit_scn string?, txId string?, rs_id string?, ssn integer?, event_serial_no integer",
    "mongodb": "resume_token string?, cluster_time_seconds integer?, cluster_time_increment integer?, event_serial_no integer",
    "bridge": "source_offset string, record_id string, event_serial_no integer",
}
TRANSACTION = "id string, total_order integer?, data_collection_order integer?"
MESSAGE = "prefix string, content string"
HEARTBEAT_KEY, HEARTBEAT = "serverName string", "ts_ms integer"
#: JSON types of wire kinds; other kinds are strings.
TYPES = {"boolean": "boolean", "int": "integer", "long": "integer", "unsigned": "integer"}


def members(line: str) -> dict[str, dict]:
    """The members that a line of text states."""
    pairs = (part.split() for part in line.split(","))
    return {name: {"type": [t[:-1], "null"] if t.endswith("?") else t} for name, t in pairs}


def closed(properties: dict[str, dict], required: Iterable[str] | None = None, **head) -> dict:
    """An object with these members and no others; all of them are required unless told otherwise."""
    need = list(properties if required is None else required)
    return head | {"type": "object", "additionalProperties": False, "properties": properties} | ({"required": need} if need else {})


def either(*alternatives: dict) -> dict:
    return {"anyOf": list(alternatives)}


NULL = {"type": "null"}


def value_schema(source_type: str) -> dict:
    """What a column that holds a value looks like."""
    k = kind(source_type)
    if k == "json":
        return {}
    if k == "map":
        return {"type": "object", "additionalProperties": {"type": ["string", "null"]}}
    if k == "double":  # NaN and infinities are written as null
        return {"type": ["number", "null"]}
    if k.startswith("array:"):
        return {"type": "array", "items": either(value_schema(source_type.strip().removesuffix("[]")), NULL)}
    return {"type": TYPES.get(k, "string")}


def column_schema(f: Field, placeholder: str) -> dict:
    """In a row image a column may also hold the placeholder of an unavailable value, or null."""
    gone = {"type": "string", "const": placeholder}
    return either(value_schema(f.source_type), gone, *[NULL] * f.optional)


def row_schema(table: Table, title: str, placeholder: str) -> dict:
    return closed({f.name: column_schema(f, placeholder) for f in table.fields}, required=(), title=title)


def _document(title: str, body: dict, **head) -> dict:
    return {"$schema": DRAFT, **head, "title": title} | body


def key_schema(table: Table, title: str) -> dict | None:
    """None for a table without a key."""
    parts = {f.name: value_schema(f.source_type) for f in table.fields if f.primary_key}
    return _document(f"{title}.Key", closed(parts)) if parts else None


def source_schema(family: str) -> dict:
    return closed(members(f"{SOURCE}, {SOURCE_OF[family]}"))


def transaction_schema() -> dict:
    return either(NULL, closed(members(TRANSACTION)))


def envelope_schema(table: Table, title: str, placeholder: str, family: str = "postgresql") -> dict:
    image = either(NULL, row_schema(table, f"{title}.Value", placeholder))
    parts = {"before": image, "after": image, "source": source_schema(family), "op": {"type": "string", "enum": list(OP_CODES.values())}, "ts_ms": {"type": "integer"}, "transaction": transaction_schema()}
    return _document(f"{title}.Envelope", closed(parts), **{"$comment": f"schema version {table.version}"})


def message_schema(title: str, family: str = "postgresql") -> dict:
    parts = {"op": {"type": "string", "const": OP_CODES["message"]}, "ts_ms": {"type": "integer"}, "source": source_schema(family), "transaction": transaction_schema(), "message": closed(members(MESSAGE))}
    return _document(f"{title}.Message", closed(parts))


def heartbeat_schemas(name: str) -> tuple[dict, dict]:
    """Key and value."""
    return _document(f"{name}.HeartbeatKey", closed(members(HEARTBEAT_KEY))), _document(f"{name}.Heartbeat", closed(members(HEARTBEAT)))


def subjects(destination: str) -> tuple[str, str]:
    return f"{destination}-key", f"{destination}-value"
