"""Avro: schemas from table schemas, and a binary writer and reader for raw datums.

Columns are unions of null, the type, and (outside keys) a string for the placeholder or
for a value kept as text. Rows are encoded in Arrow batches with the schema compiled once a worker.
"""

from __future__ import annotations

import functools
import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.schema_history import Table
from .json_schema import MESSAGE, SOURCE, SOURCE_OF, TRANSACTION
from .kinds import adjusted_all, kind


def base_schema(source_type: str):
    k = kind(source_type)
    if k.startswith("array:"):
        item = base_schema(source_type.strip()[:-2])
        return {"type": "array", "items": ["null", item] if item == "string" else ["null", item, "string"]}
    return {"map": {"type": "map", "values": ["null", "string"]}, "boolean": "boolean", "int": "int", "long": "long", "double": "double", "bytes": "bytes"}.get(k, "string")


def row_schema(table: Table, name: str, key: bool = False) -> dict:
    names = adjusted_all([f.name for f in table.fields])
    fields = []
    for f in table.fields:
        if key and not f.primary_key:
            continue
        base = base_schema(f.source_type)
        union = base if key else ["null", base] if base == "string" else ["null", base, "string"]
        fields.append({"name": names[f.name], "type": union, **({} if key else {"default": None})})
    return {"type": "record", "name": name, "fields": fields}


def record(name: str, line: str) -> dict:
    """A record from the members that a line of ``json_schema`` states; a member that may be null is a union."""
    base = {"string": "string", "integer": "long"}
    pairs = (part.split() for part in line.split(","))
    return {"type": "record", "name": name, "fields": [{"name": n, "type": ["null", base[t[:-1]]] if t.endswith("?") else base[t]} for n, t in pairs]}


def envelope_schema(table: Table, family: str) -> dict:
    """The envelope of a table's changes; the row's record is spelled out in both images (``named`` refers to it)."""
    row = row_schema(table, "Value")
    source, tx = record("Source", f"{SOURCE}, {SOURCE_OF[family]}"), record("Transaction", TRANSACTION)
    types = {"before": ["null", row], "after": ["null", row], "source": source, "op": "string", "ts_ms": ["null", "long"], "transaction": ["null", tx]}
    return {"type": "record", "name": "Envelope", "fields": [{"name": n, "type": t} for n, t in types.items()]}


def message_schema(family: str) -> dict:
    source, tx = record("Source", f"{SOURCE}, {SOURCE_OF[family]}"), record("Transaction", TRANSACTION)
    types = {"op": "string", "ts_ms": ["null", "long"], "source": source, "transaction": ["null", tx], "message": record("Message", MESSAGE)}
    return {"type": "record", "name": "MessageEnvelope", "fields": [{"name": n, "type": t} for n, t in types.items()]}


def named(schema, seen: set[str] | None = None):
    """A schema as it is published: a record that has been defined is referred to by its name."""
    seen = set() if seen is None else seen
    if isinstance(schema, list):
        return [named(x, seen) for x in schema]
    if isinstance(schema, dict) and schema["type"] == "record":
        if schema["name"] in seen:
            return schema["name"]
        seen.add(schema["name"])
        return schema | {"fields": [f | {"type": named(f["type"], seen)} for f in schema["fields"]]}
    return schema


def _long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(b: bytes) -> bytes:
    return _long(len(b)) + b


def encode(schema, value) -> bytes:
    """A value as a raw datum. Integers out of range are an error; other mismatches fall back to a string branch."""
    if isinstance(schema, list):
        for i, branch in enumerate(schema):
            if fits(branch, value):
                return _long(i) + encode(branch, value)
        if "string" in schema:
            if isinstance(value, int) and not isinstance(value, bool) and ("int" in schema or "long" in schema):
                raise ValueError(f"integer out of range: {value}")
            return _long(schema.index("string")) + encode("string", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
        raise ValueError(f"{value!r} is none of {schema}")
    t = schema["type"] if isinstance(schema, dict) else schema
    if t == "null":
        return b""
    if t == "boolean":
        return b"\x01" if value else b"\x00"
    if t in ("int", "long"):
        if not fits(t, value):
            raise ValueError(f"not in the range of {t}: {value!r}")
        return _long(value)
    if t == "double":
        return struct.pack("<d", value)
    if t == "bytes":
        return _bytes(bytes(value))
    if t == "string":
        return _bytes(value.encode())
    if t == "array":
        return (_long(len(value)) + b"".join(encode(schema["items"], v) for v in value) if value else b"") + b"\x00"
    if t == "map":
        return (_long(len(value)) + b"".join(_bytes(k.encode()) + encode(schema["values"], v) for k, v in sorted(value.items())) if value else b"") + b"\x00"
    if t == "record":
        return b"".join(encode(f["type"], value.get(f["name"])) for f in schema["fields"])
    raise ValueError(f"unknown type: {t}")


def fits(schema, value) -> bool:
    t = schema["type"] if isinstance(schema, dict) else schema
    whole = isinstance(value, int) and not isinstance(value, bool)
    return {
        "null": value is None, "boolean": isinstance(value, bool), "int": whole and -(2**31) <= value < 2**31, "long": whole and -(2**63) <= value < 2**63, "double": isinstance(value, float) or whole,
        "bytes": isinstance(value, (bytes, bytearray)), "string": isinstance(value, str), "array": isinstance(value, list), "map": isinstance(value, dict), "record": isinstance(value, dict),
    }[t]


def decode(schema, data: bytes):
    value, at = _decode(schema, data, 0)
    if at != len(data):
        raise ValueError("bytes left over")
    return value


def _decode(schema, data: bytes, at: int):
    def long(at: int):
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return (n >> 1) ^ -(n & 1), at

    if isinstance(schema, list):
        i, at = long(at)
        return _decode(schema[i], data, at)
    t = schema["type"] if isinstance(schema, dict) else schema
    if t == "null":
        return None, at
    if t == "boolean":
        return data[at] == 1, at + 1
    if t in ("int", "long"):
        return long(at)
    if t == "double":
        return struct.unpack_from("<d", data, at)[0], at + 8
    if t in ("bytes", "string"):
        n, at = long(at)
        raw = data[at : at + n]
        return (raw.decode() if t == "string" else raw), at + n
    if t == "record":
        out = {}
        for f in schema["fields"]:
            out[f["name"]], at = _decode(f["type"], data, at)
        return out, at
    out = [] if t == "array" else {}
    while True:
        n, at = long(at)
        if not n:
            return out, at
        for _ in range(n):
            if t == "array":
                v, at = _decode(schema["items"], data, at)
                out.append(v)
            else:
                k, at = _decode("string", data, at)
                out[k], at = _decode(schema["values"], data, at)


@functools.lru_cache(maxsize=256)
def parsed(definition: str):
    return json.loads(definition)


def encode_json(rows: Column, schema: dict) -> Column:
    """JSON objects (by adjusted column name) as Avro datums; null stays null."""
    definition = json.dumps(schema)

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        s = parsed(definition)
        return texts.map(lambda t: None if t is None else encode(s, json.loads(t)))

    return run(rows)
