"""Protobuf: message text from table schemas, and a writer for the wire format.

Field numbers follow from column names, so a schema that gains columns stays compatible.
Every column is a message that holds either a value, the mark of an unavailable one, or text.
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
from .kinds import adjusted_all, field_numbers, kind

WIRE = {"boolean": "bool", "int": "int32", "long": "int64", "unsigned": "uint64", "double": "double", "bytes": "bytes"}
#: Numbers inside a column's message.
VALUE, UNAVAILABLE, TEXT = 1, 2, 3


def proto_type(source_type: str) -> str:
    return WIRE.get(kind(source_type), "string")


def definition(table: Table, package: str, message: str = "Value") -> str:
    """The ``.proto`` text of a row."""
    names, numbers = adjusted_all([f.name for f in table.fields]), field_numbers([f.name for f in table.fields])
    lines = ['syntax = "proto3";', f"package {package};", f"message {message} {{"]
    for f in table.fields:
        k, label = kind(f.source_type), f"{names[f.name]}_column"
        inner = f"repeated {proto_type(f.source_type.strip()[:-2])} items" if k.startswith("array:") else "map<string, string> entries" if k == "map" else None
        if inner:
            lines += [f"  message {label} {{ {inner} = {VALUE}; bool unavailable = {UNAVAILABLE}; string text = {TEXT}; }}"]
        else:
            lines += [f"  message {label} {{ oneof kind {{ {proto_type(f.source_type)} value = {VALUE}; bool unavailable = {UNAVAILABLE}; string text = {TEXT}; }} }}"]
        lines.append(f"  {label} {names[f.name]} = {numbers[f.name]};")
    return "\n".join([*lines, "}", ""])


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _tagged(number: int, wire: int, body: bytes) -> bytes:
    return _varint(number << 3 | wire) + body


def _delimited(number: int, body: bytes) -> bytes:
    return _tagged(number, 2, _varint(len(body)) + body)


LIMITS = {"int32": (-(2**31), 2**31), "int64": (-(2**63), 2**63), "uint64": (0, 2**64)}


def scalar(number: int, type_name: str, value) -> bytes | None:
    """A field, or None if the value is not of the type."""
    if type_name == "bool" and isinstance(value, bool):
        return _tagged(number, 0, _varint(int(value)))
    if type_name in LIMITS and isinstance(value, int) and not isinstance(value, bool):
        low, high = LIMITS[type_name]
        if not low <= value < high:
            raise ValueError(f"not in the range of {type_name}: {value}")
        return _tagged(number, 0, _varint(value))
    if type_name == "double" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return _tagged(number, 1, struct.pack("<d", value))
    if type_name == "bytes" and isinstance(value, (bytes, bytearray)):
        return _delimited(number, bytes(value))
    if type_name == "string" and isinstance(value, str):
        return _delimited(number, value.encode())
    return None


def encode_row(fields: list[tuple[str, str]], row: dict, placeholder: str) -> bytes:
    """A row as wire bytes, by field number; a null column is left out."""
    out = []
    numbers = field_numbers([n for n, _ in fields])
    for name, source_type in sorted(fields, key=lambda f: numbers[f[0]]):
        value, k = row.get(name), kind(source_type)
        if value is None:
            continue
        if value == placeholder:
            body = _tagged(UNAVAILABLE, 0, b"\x01")
        elif k.startswith("array:") and isinstance(value, list):
            t = proto_type(source_type.strip()[:-2])
            body = b"".join(scalar(VALUE, t, v) or _delimited(VALUE, str(v).encode()) for v in value if v is not None)
        elif k == "map" and isinstance(value, dict):
            body = b"".join(_delimited(VALUE, _delimited(1, key.encode()) + (b"" if v is None else _delimited(2, v.encode()))) for key, v in sorted(value.items()))
        else:
            body = scalar(VALUE, proto_type(source_type), value)
            if body is None:
                body = _delimited(TEXT, (value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)).encode())
        out.append(_delimited(numbers[name], body))
    return b"".join(out)


#: Numbers of the envelope's parts, and of a message's.
ENVELOPE = {"before": 1, "after": 2, "source": 3, "op": 4, "ts_ms": 5, "transaction": 6}
MESSAGE_ENVELOPE = {"op": 1, "ts_ms": 2, "source": 3, "transaction": 4, "message": 5}


def _line(line: str) -> list[tuple[str, str]]:
    """(name, type) of the members that a line of ``json_schema`` states; they are numbered in order."""
    return [(name, {"string": "string", "integer": "int64"}[t.rstrip("?")]) for name, t in (part.split() for part in line.split(","))]


def _part(line: str, value: dict) -> bytes:
    return b"".join(scalar(i, t, value[n]) or b"" for i, (n, t) in enumerate(_line(line), 1) if value.get(n) is not None)


def envelope_definition(table: Table, package: str, family: str) -> str:
    """The ``.proto`` text of a table's envelope."""
    parts = {"Source": f"{SOURCE}, {SOURCE_OF[family]}", "Transaction": TRANSACTION}
    body = [f"message {name} {{ " + " ".join(f"optional {t} {n} = {i};" for i, (n, t) in enumerate(_line(line), 1)) + " }" for name, line in parts.items()]
    types = {"before": "Value", "after": "Value", "source": "Source", "op": "string", "ts_ms": "int64", "transaction": "Transaction"}
    body.append("message Envelope { " + " ".join(f"{types[n]} {n} = {i};" for n, i in ENVELOPE.items()) + " }")
    return definition(table, package) + "\n".join(body) + "\n"


def encode_envelope(fields: list[tuple[str, str]], envelope: dict, placeholder: str, family: str) -> bytes:
    """An envelope of ``encode.json`` (or a message's) as wire bytes; parts that are null are left out."""
    numbers, source = MESSAGE_ENVELOPE if "message" in envelope else ENVELOPE, f"{SOURCE}, {SOURCE_OF[family]}"
    made = {
        "before": lambda v: encode_row(fields, v, placeholder), "after": lambda v: encode_row(fields, v, placeholder), "source": lambda v: _part(source, v), "transaction": lambda v: _part(TRANSACTION, v), "message": lambda v: _part(MESSAGE, v),
    }
    out = b""
    for name, number in numbers.items():
        value = envelope.get(name)
        if value is not None:
            out += _delimited(number, made[name](value)) if name in made else scalar(number, "string" if name == "op" else "int64", value)
    return out


@functools.lru_cache(maxsize=256)
def parsed(fields: str) -> list[tuple[str, str]]:
    return [tuple(f) for f in json.loads(fields)]


def encode_json(rows: Column, table: Table, placeholder: str) -> Column:
    """JSON objects (by column name) as wire bytes; null stays null."""
    fields = json.dumps([(f.name, f.source_type) for f in table.fields])

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        known = parsed(fields)
        return texts.map(lambda t: None if t is None else encode_row(known, json.loads(t), placeholder))

    return run(rows)
