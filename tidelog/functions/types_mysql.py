"""MySQL values: by declared type, in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind_of(source_type: str) -> str:
    """boolean, unsigned, integer, float, decimal, bytes, json, time or string."""
    t = source_type.strip().lower()
    base = t.split("(")[0].split(" ")[0]
    if t.startswith("tinyint(1)"):
        return "boolean"
    if "unsigned" in t and base.endswith("int"):
        return "unsigned"
    if base in {"tinyint", "smallint", "mediumint", "int", "integer", "bigint", "year"}:
        return "integer"
    if base in {"float", "double", "real"}:
        return "float"
    if base in {"decimal", "numeric"}:
        return "decimal"
    if base in {"bit", "binary", "varbinary", "tinyblob", "blob", "mediumblob", "longblob"} or base in SPATIAL:
        return "bytes"
    return {"json": "json", "time": "time"}.get(base, "string")


SPATIAL = {"geometry", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon", "geometrycollection"}
SPARK = {"boolean": "boolean", "unsigned": "decimal(20,0)", "integer": "bigint", "float": "double", "decimal": "string", "bytes": "binary", "json": "string", "time": "string", "string": "string"}


def value(text: Column, source_type: str) -> Column:
    kind = kind_of(source_type)
    if kind == "boolean":
        return text.try_cast("bigint") != 0
    return text.try_cast(SPARK[kind])


def timestamp_text(epoch: Column) -> Column:
    """``seconds[.fraction]`` since 1970 as ``Y-m-d H:M:S[.ffffff]``, UTC; the fraction is written when there is one."""
    seconds, fraction = F.substring_index(epoch, ".", 1).cast("bigint"), F.when(epoch.contains("."), F.rpad(F.substring_index(epoch, ".", -1), 6, "0"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")
    of_day = F.pmod(seconds, F.lit(86_400))
    clock = F.concat_ws(":", *[F.lpad(x.cast("bigint").cast("string"), 2, "0") for x in (F.floor(of_day / 3600), F.floor(of_day / 60) % 60, of_day % 60)])
    return F.concat(day, F.lit(" "), clock, F.when(fraction.isNotNull() & (fraction != "000000"), F.concat(F.lit("."), fraction)).otherwise(""))


def time_text(micros: Column) -> Column:
    """A time span, which may be negative or longer than a day, as ``[-]HHH:MM:SS[.ffffff]``."""
    m = F.abs(micros)
    seconds, fraction = F.floor(m / 1_000_000).cast("bigint"), (m % 1_000_000).cast("bigint")
    hours = F.floor(seconds / 3600).cast("bigint").cast("string")
    clock = F.concat_ws(":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), *[F.lpad(x.cast("bigint").cast("string"), 2, "0") for x in (F.floor(seconds / 60) % 60, seconds % 60)])
    return F.when(micros.isNotNull(), F.concat(F.when(micros < 0, "-").otherwise(""), clock, F.when(fraction > 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))).otherwise("")))


def _labels(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def enum_label(index: Column, values: Sequence[str]) -> Column:
    """The label of a 1-based index; empty for 0 and for an index out of range."""
    return F.when(index.isNull(), None).otherwise(F.coalesce(F.get(_labels(values), (index - 1).cast("int")), F.lit("")))


def set_labels(mask: Column, values: Sequence[str]) -> Column:
    """The labels of the bits that are set, comma-joined."""
    return F.array_join(F.filter(_labels(values), lambda _, i: F.expr("1L").bitwiseAND(F.call_function("shiftright", mask.cast("bigint"), i)) == 1), ",")
