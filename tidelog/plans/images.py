"""Row images on their way to a sink: masking, keys, and binary encoders.

Which tables and columns an image has is known only from its row, so rules and schemas are
looked up by table inside Arrow batches, once a worker for each table. Masking changes the
members that a rule names and leaves all other text of the image as it is, byte for byte.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Callable, Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config, TableSchema
from ..encode import avro, json_schema, protobuf
from ..encode.frame import Registry
from ..encode.kinds import adjusted_all
from ..functions.masking import BINARY_TYPES, Rule, base_type, candidates, declared_length, digest, is_character, java_string, rule_for

_DECODER = json.JSONDecoder()


def members(text: str) -> Iterator[tuple[str, int, int]]:
    """(name, begin, end) of the value of each member of an object, in order."""
    skip = lambda i: next((j for j in range(i, len(text)) if text[j] not in " \t\n\r"), len(text))
    i = skip(0)
    if text[i : i + 1] != "{":
        raise ValueError("an image is not an object")
    i = skip(i + 1)
    while text[i : i + 1] != "}":
        name, i = scanstring(text, i + 1)
        begin = skip(skip(i) + 1)
        _, end = _DECODER.raw_decode(text, begin)
        yield name, begin, end
        i = skip(end)
        i = skip(i + 1) if text[i : i + 1] == "," else i


def masked_json(raw: str, rule: Rule, source_type: str | None, placeholder: str) -> str:
    """A member's value under its rule, as JSON text.

    Without a declared type a text or a null counts as a character column: what may be one is not let through.
    """
    value = json.loads(raw)
    character = is_character(source_type) if source_type is not None else value is None or isinstance(value, str)
    gone = value is None or value == placeholder
    if rule.kind == "mask":
        return json.dumps("*" * rule.length) if character else raw
    if gone or not isinstance(value, str):
        return raw
    if rule.kind == "truncate":
        if source_type is not None and base_type(source_type) in BINARY_TYPES:
            return json.dumps(base64.b64encode(base64.b64decode(value)[: rule.length]).decode())
        return json.dumps(value[: rule.length], ensure_ascii=False) if character else raw
    if not character:
        return raw
    data = java_string(value) if rule.kind == "hash_v1" else value.encode("utf-8", "surrogatepass")
    length = rule.length or (declared_length(source_type) if source_type else None)
    return json.dumps(digest(rule.algorithm, rule.salt.encode() + data)[:length])


def mask_image(text: str, rule_of: Callable[[str], tuple[Rule | None, str | None]], placeholder: str) -> str:
    out, at = [], 0
    for name, begin, end in members(text):
        rule, source_type = rule_of(name)
        if rule:
            out += [text[at:begin], masked_json(text[begin:end], rule, source_type, placeholder)]
            at = end
    return "".join([*out, text[at:]])


def table_name(schema: str | None, database: str | None, table: str | None) -> str:
    return ".".join(x for x in (schema or database, table) if x)


def masked(image: Column, config: Config, database: Column, schema: Column, table: Column) -> Column:
    """A JSON image under the configured rules; null stays null. Without rules it is the column itself."""
    if not config.columns:
        return image
    rules, family, placeholder = [c.rule() for c in config.columns], config.source.family, config.format.placeholder
    types = {t.name: {c.name: c.type for c in t.columns} for t in config.tables}

    @F.pandas_udf("string")
    def run(images: pd.Series, databases: pd.Series, schemas: pd.Series, tables: pd.Series) -> pd.Series:
        @functools.cache
        def found(db: str, sch: str | None, tbl: str, column: str) -> tuple[Rule | None, str | None]:
            names = candidates(family, db, sch, tbl, column)
            if family == "bridge" and sch is not None:  # documents of any database come in here
                names += [f"{sch}.{tbl}.{column}", f"{db}.{sch}.{tbl}.{column}"]
            return rule_for(rules, names), types.get(table_name(sch, db, tbl), {}).get(column)

        return pd.Series([None if t is None else mask_image(t, lambda c, at=(db, sch, tbl): found(*at, c), placeholder) for t, db, sch, tbl in zip(images, databases, schemas, tables, strict=True)], dtype=object)

    return run(image, database, schema, table)


def declared_key(image: Column, config: Config, name: Column) -> Column:
    """The key of a declared table from an image: its key columns in the order of the schema; null for a table without a key."""
    keys = {t.name: [c.name for c in t.columns if c.key] for t in config.tables}

    @F.pandas_udf("string")
    def run(images: pd.Series, names: pd.Series) -> pd.Series:
        def one(text: str | None, table: str) -> str | None:
            wanted = keys.get(table)
            if text is None or not wanted:
                return None
            found = {n: text[a:b] for n, a, b in members(text)}
            return "{" + ",".join(f"{json.dumps(n, ensure_ascii=False)}:{found.get(n, 'null')}" for n in wanted) + "}"

        return pd.Series([one(t, n) for t, n in zip(images, names, strict=True)], dtype=object)

    return run(image, name)


# binary formats


def _encoder(kind: str, family: str, placeholder: str, tables: list[TableSchema]) -> tuple[Callable[[str, str], bytes], Callable[[str, str], bytes]]:
    """Functions of (table, JSON text) for keys and for envelopes; messages belong to no table."""
    known = {t.name: t.table() for t in tables}

    def table(name: str):
        if name not in known:
            raise ValueError(f"no schema for table {name}")
        return known[name]

    @functools.cache
    def shape(n: str):
        """What the table's rows are written by: Avro schemas and adjusted names, or (name, type) pairs."""
        t = table(n)
        if kind == "avro":
            return avro.row_schema(t, "Key", key=True), avro.envelope_schema(t, family), adjusted_all([f.name for f in t.fields])
        return [(f.name, f.source_type) for f in t.fields if f.primary_key], [(f.name, f.source_type) for f in t.fields]

    def renamed(row: dict | None, names: dict[str, str]) -> dict | None:
        return None if row is None else {names[k]: v for k, v in row.items() if k in names}

    def key(n: str, text: str) -> bytes:
        if kind == "json_schema":
            return text.encode()
        if kind == "protobuf":
            return protobuf.encode_row(shape(n)[0], json.loads(text), placeholder)
        return avro.encode(shape(n)[0], renamed(json.loads(text), shape(n)[2]))

    def value(n: str, text: str) -> bytes:
        envelope = json.loads(text)
        of_table = "message" not in envelope
        if kind == "json_schema":
            if of_table:
                table(n)
            return text.encode()
        if kind == "protobuf":
            return protobuf.encode_envelope(shape(n)[1] if of_table else [], envelope, placeholder, family)
        if not of_table:
            return avro.encode(avro.message_schema(family), envelope)
        return avro.encode(shape(n)[1], envelope | {side: renamed(envelope[side], shape(n)[2]) for side in ("before", "after")})

    return key, value


def definitions(config: Config, name: str, destination: str) -> tuple[str | None, str]:
    """The texts of a declared table's key and value schemas in the configured format."""
    t = next(x for x in config.tables if x.name == name).table()
    family, has_key = config.source.family, any(f.primary_key for f in t.fields)
    if config.format.kind == "json_schema":
        key, value = json_schema.key_schema(t, destination), json_schema.envelope_schema(t, destination, config.format.placeholder, family)
        return key and json.dumps(key), json.dumps(value)
    if config.format.kind == "avro":
        return json.dumps(avro.row_schema(t, "Key", key=True)) if has_key else None, json.dumps(avro.named(avro.envelope_schema(t, family)))
    only_key = type(t)(t.name, t.version, [f for f in t.fields if f.primary_key])
    return protobuf.definition(only_key, "tidelog", "Key") if has_key else None, protobuf.envelope_definition(t, "tidelog", family)


def schema_ids(config: Config) -> dict[str, tuple[int | None, int]]:
    """The registry's ids for keys and values of the declared tables; asked for once, on the driver."""
    registry, out = Registry(config.sink.registry), {}
    prefix = config.sink.prefix or config.name
    for t in config.tables:
        destination = ".".join([prefix, *([config.source.database] if config.source.family in ("postgresql", "oracle") and config.source.database else []), t.name])
        key, value = definitions(config, t.name, destination)
        subjects = json_schema.subjects(destination)
        out[t.name] = (None if key is None else registry.register(subjects[0], key), registry.register(subjects[1], value))
    return out


def encoded(key: Column, value: Column, config: Config, name: Column) -> tuple[Column, Column]:
    """Key and value (JSON texts) as bytes of the configured format, framed if a registry is configured."""
    kind, family, placeholder, tables = config.format.kind, config.source.family, config.format.placeholder, config.tables
    ids = schema_ids(config) if config.sink.registry else None

    def column(part: int, text: Column) -> Column:
        @F.pandas_udf("binary")
        def run(texts: pd.Series, names: pd.Series) -> pd.Series:
            encode = _encoder(kind, family, placeholder, tables)[part]

            def framed(n: str, body: bytes) -> bytes:
                number = None if ids is None else ids.get(n, (None, None))[part]
                return body if number is None else b"\x00" + number.to_bytes(4, "big") + b"\x00" * (kind == "protobuf") + body

            return pd.Series([None if t is None else framed(n, encode(n, t)) for t, n in zip(texts, names, strict=True)], dtype=object)

        return run(text, name)

    return column(0, key), column(1, value)
