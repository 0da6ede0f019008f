"""Declared types to wire kinds: one rule for all encoders."""

from __future__ import annotations

import hashlib
import re

#: Kinds by declared type.
SMALL = {"tinyint", "smallint", "mediumint", "int", "integer", "serial", "year", "int2", "int4", "smallserial"}
BIG = {"bigint", "bigserial", "int8"}
FLOATS = {"real", "float", "double", "double precision", "float4", "float8"}
BINARY = {"binary", "varbinary", "blob", "tinyblob", "mediumblob", "longblob", "bytea", "image", "rowversion", "bit", "geometry", "geography"}


def kind(source_type: str) -> str:
    """array:<kind>, map, json, boolean, unsigned, decimal, int, long, double, bytes or string."""
    t = re.sub(r"\s+", " ", source_type.strip().lower())
    if t.endswith("[]"):
        return f"array:{kind(t[:-2])}"
    base = re.sub(r"\s*\(.*?\)", "", t).strip()
    if base.startswith(("hstore", "map", "sparsevec")):
        return "map"
    if base in ("json", "jsonb"):
        return "json"
    if base in ("bool", "boolean") or t.startswith("tinyint(1)"):
        return "boolean"
    if "unsigned" in base or base == "oid":
        return "unsigned"
    if base in ("decimal", "numeric", "money"):
        return "decimal"
    if base in SMALL:
        return "int"
    if base in BIG:
        return "long"
    if base in FLOATS:
        return "double"
    if base in BINARY:
        return "bytes"
    return "string"


def adjusted(name: str) -> str:
    """A name that all formats allow."""
    out = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return f"_{out}" if out[:1].isdigit() else out


def adjusted_all(names: list[str]) -> dict[str, str]:
    """Adjusted names by name; two names that become one are an error."""
    out = {n: adjusted(n) for n in names}
    if len(set(out.values())) < len(out):
        raise ValueError(f"names collide after adjustment: {sorted(out)}")
    return out


def field_number(name: str) -> int:
    """A Protobuf field number that follows from the column's own name and avoids the reserved range."""
    n = int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "big") % 536_870_911 + 1
    return n + 1_000 if 19_000 <= n <= 19_999 else n


def field_numbers(names: list[str]) -> dict[str, int]:
    out = {n: field_number(n) for n in names}
    if len(set(out.values())) < len(out):
        raise ValueError(f"field numbers collide: {out}")
    return out
