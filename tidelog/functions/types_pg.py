"""PostgreSQL text to values.

A text that does not parse is kept as text, never turned into null: typed functions give
(value, failed) so that a caller can fall back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed(text: Column, spark_type: str) -> tuple[Column, Column]:
    """(value or null, whether the text did not parse)."""
    value = text.try_cast(spark_type)
    return value, text.isNotNull() & value.isNull()


def boolean(text: Column) -> Column:
    return F.when(text.isin("t", "true"), True).when(text.isin("f", "false"), False)


def bytea(text: Column) -> Column:
    return F.when(text.rlike("^\\\\x([0-9a-fA-F]{2})*$"), F.unhex(F.substring(text, 3, 2147483647)))


def money(text: Column, scale: int = 2) -> Column:
    """An amount with one currency sign, thousands separators and either sign form, rounded half up; null if the text is anything else.

    Parentheses count as a pair only. What is left after one sign, one currency character and the commas must be a plain number.
    """
    trimmed = F.trim(text)
    paired = trimmed.rlike("^\\(.*\\)$")
    inner = F.when(paired, F.trim(F.regexp_extract(trimmed, "^\\((.*)\\)$", 1))).otherwise(trimmed)
    number = F.replace(F.regexp_extract(inner, "^-?\\s*[^0-9.]?([0-9.,]+)$", 1), F.lit(","), F.lit(""))
    plain = F.when(number.rlike("^([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), number).try_cast("decimal(38,10)")
    return F.round(F.when(paired | inner.startswith("-"), -plain).otherwise(plain), scale).cast(f"decimal(38,{scale})")


def interval_parts(text: Column) -> Column:
    """months, days, micros of an interval in the ``1 year 2 mons 3 days 04:05:06.789`` or ISO style; null if it is neither."""
    iso = text.startswith("P") | text.startswith("-P")
    spelled = F.regexp_replace(F.regexp_replace(text, "^@ ", ""), " ago$", "")
    sign = F.when(text.endswith(" ago"), -1).otherwise(1)

    def number(words: str, letter: str, time_part: bool) -> Column:
        verbose = F.regexp_extract(spelled, f"([+-]?\\d+(?:\\.\\d+)?) (?:{words})", 1)
        head = F.substring_index(text, "T", 1)
        tail = F.when(text.contains("T"), F.substring_index(text, "T", -1)).otherwise("")
        coded = F.regexp_extract(tail if time_part else head, f"([+-]?\\d+(?:\\.\\d+)?){letter}", 1)
        return F.coalesce(F.when(iso, coded).otherwise(verbose).try_cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))

    clock = "([+-]?)(\\d+):(\\d+)(?::(\\d+(?:\\.\\d+)?))?"
    part = lambda i: F.coalesce(F.regexp_extract(spelled, clock, i).try_cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
    of_clock = (part(2) * 3600 + part(3) * 60 + part(4)) * F.when(F.regexp_extract(spelled, clock, 1) == "-", -1).otherwise(1)
    seconds = number("hours?|hrs?", "H", True) * 3600 + number("mins?|minutes?", "M", True) * 60 + number("secs?|seconds?", "S", True) + F.when(iso, 0).otherwise(of_clock)
    months = number("years?", "Y", False) * 12 + number("mons?|months?", "M", False)
    days = number("weeks?", "W", False) * 7 + number("days?", "D", False)
    known = text.rlike("^-?P(?=[0-9T+-])[-+0-9.YMWD]*(T[-+0-9.HMS]+)?$") | text.rlike("^(@ )?(\\s*[+-]?\\d+(\\.\\d+)? (years?|mons?|months?|weeks?|days?|hours?|hrs?|mins?|minutes?|secs?|seconds?))*\\s*([+-]?\\d+:\\d+(:\\d+(\\.\\d+)?)?)?( ago)?$")
    return F.when(known & (F.trim(text) != ""), F.struct((months * sign).cast("bigint").alias("months"), (days * sign).cast("bigint").alias("days"), (seconds * 1_000_000 * sign).cast("bigint").alias("micros")))


def interval_micros(parts: Column) -> Column:
    """Microseconds, a month being a twelfth of 365.25 days; cut toward zero."""
    month_days = parts["months"].cast("decimal(20,0)") * F.lit("365.25").cast("decimal(6,2)") / 12
    return (month_days.cast("double") * 86_400_000_000.0 + parts["days"].cast("double") * 86_400_000_000.0 + parts["micros"].cast("double")).cast("bigint")


def interval_iso(parts: Column) -> Column:
    """``P1Y2M3DT4H5M6.789S``; all fields are written."""
    months, days, micros = parts["months"], parts["days"], parts["micros"]
    cut = lambda a, b: F.when(a < 0, -F.floor(-a / b)).otherwise(F.floor(a / b)).cast("bigint")
    hours = cut(micros, 3_600_000_000)
    minutes = cut(micros - hours * 3_600_000_000, 60_000_000)
    left = micros - hours * 3_600_000_000 - minutes * 60_000_000
    seconds = F.regexp_replace(F.regexp_replace((left.cast("decimal(20,6)") / F.lit(1_000_000)).cast("decimal(20,6)").cast("string"), "0+$", ""), "\\.$", "")
    years = cut(months, 12)
    return F.concat(F.lit("P"), years.cast("string"), F.lit("Y"), (months - years * 12).cast("string"), F.lit("M"), days.cast("string"), F.lit("DT"), hours.cast("string"), F.lit("H"), minutes.cast("string"), F.lit("M"), seconds, F.lit("S"))


def dense_vector(text: Column) -> Column:
    return F.when(text.rlike("^\\[.*\\]$"), F.from_json(text, "array<double>"))


def sparse_vector(text: Column) -> Column:
    """``{1:0.5,3:2}/5`` as dimensions and a map of position to value."""
    body, dims = F.regexp_extract(text, "^\\{(.*)\\}/(\\d+)$", 1), F.regexp_extract(text, "^\\{(.*)\\}/(\\d+)$", 2)
    entries = F.transform(F.array_remove(F.split(body, ","), ""), lambda e: F.struct(F.trim(F.split_part(e, F.lit(":"), F.lit(1))).cast("int").alias("key"), F.split_part(e, F.lit(":"), F.lit(2)).cast("double").alias("value")))
    return F.when(text.rlike("^\\{.*\\}/\\d+$"), F.struct(dims.cast("int").alias("dimensions"), F.map_from_entries(entries).alias("vector")))


# texts with quotes and escapes need a scanner; it runs over Arrow batches


def parse_hstore(text: str | None) -> dict[str, str | None] | None:
    """``"a"=>"1", b=>NULL``; None if the text is not of that form."""
    if text is None:
        return None
    out, i = {}, 0

    def token(i: int) -> tuple[str, bool, int]:
        if i < len(text) and text[i] == '"':
            part, i = [], i + 1
            while i < len(text) and text[i] != '"':
                i += text[i] == "\\"
                part.append(text[i : i + 1])
                i += 1
            if i >= len(text):
                raise ValueError
            return "".join(part), True, i + 1
        j = i
        while j < len(text) and text[j] not in ',= "':
            j += 1
        if j == i:
            raise ValueError
        return text[i:j], False, j

    def blank(i: int) -> int:
        while i < len(text) and text[i].isspace():
            i += 1
        return i

    try:
        i = blank(0)
        while i < len(text):
            key, _, i = token(i)
            i = blank(i)
            if text[i : i + 2] != "=>":
                return None
            value, quoted, i = token(blank(i + 2))
            out[key] = None if not quoted and value.upper() == "NULL" else value
            i = blank(i)
            if i < len(text):
                if text[i] != ",":
                    return None
                i = blank(i + 1)
    except (ValueError, IndexError):
        return None
    return dict(sorted(out.items()))


def parse_array(text: str | None, delimiter: str = ",") -> list | None:
    """``{1,NULL,"a b",{2}}``, also with ``[1:2]=`` before it; elements stay text. None if malformed; an empty element must be quoted."""
    if text is None:
        return None
    if text.startswith("["):
        text = text.partition("=")[2]
    at = 0

    def value() -> list:
        nonlocal at
        if text[at] != "{":
            raise ValueError
        at += 1
        out: list = []
        if text[at] == "}":
            at += 1
            return out
        while True:
            if text[at] == "{":
                out.append(value())
            elif text[at] == '"':
                at, part = at + 1, []
                while text[at] != '"':
                    at += text[at] == "\\"
                    part.append(text[at])
                    at += 1
                at += 1
                out.append("".join(part))
            else:
                part = []
                while text[at] not in (delimiter, "}"):
                    at += text[at] == "\\"
                    part.append(text[at])
                    at += 1
                word = "".join(part).strip()
                if not word:
                    raise ValueError
                out.append(None if word == "NULL" else word)
            if text[at] == "}":
                at += 1
                return out
            if text[at] != delimiter:
                raise ValueError
            at += 1

    try:
        found = value()
        return found if at == len(text) else None
    except (ValueError, IndexError):
        return None


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def hstore(texts: pd.Series) -> pd.Series:
    return texts.map(parse_hstore)


@F.pandas_udf(T.ArrayType(T.StringType()))
def array(texts: pd.Series) -> pd.Series:
    """One-dimensional arrays; inner arrays come back as JSON text."""
    import json

    flat = lambda a: None if a is None else [json.dumps(x) if isinstance(x, list) else x for x in a]
    return texts.map(lambda t: flat(parse_array(t)))


#: Scalar types with a typed conversion.
SCALARS = {
    "bool": "boolean", "boolean": "boolean", "int2": "int", "smallint": "int", "int4": "int", "integer": "int", "int": "int", "int8": "bigint", "bigint": "bigint", "oid": "decimal(20,0)",
    "float4": "double", "real": "double", "float8": "double", "double precision": "double", "numeric": "string", "decimal": "string", "money": "string", "text": "string", "varchar": "string",
    "character varying": "string", "bpchar": "string", "char": "string", "name": "string", "citext": "string", "uuid": "string", "json": "string", "jsonb": "string", "date": "string", "time": "string",
    "timetz": "string", "timestamp": "string", "timestamptz": "string", "interval": "string", "bytea": "binary", "inet": "string", "cidr": "string", "macaddr": "string", "bit": "string", "varbit": "string",
    "xml": "string", "tsvector": "string", "tsquery": "string", "ltree": "string", "point": "string", "hstore": "map<string,string>", "vector": "array<double>", "geometry": "binary", "geography": "binary",
}


def supported(type_name: str, kind: str = "b", base: str | None = None) -> bool:
    """Whether a type is converted: known scalars, ranges and enums, domains over them, arrays of them."""
    name = type_name.strip().lower()
    if name.endswith("[]"):
        return supported(name[:-2], kind, base)
    if kind in ("r", "m", "e"):
        return True
    if kind == "d":
        return base is not None and supported(base)
    return name in SCALARS
