"""Document values: extended JSON and bridge JSON."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(value):
    """Extended JSON to plain: object ids, dates, decimals, timestamps, patterns; undefined is null."""
    if isinstance(value, list):
        return [plain(v) for v in value]
    if not isinstance(value, dict):
        return value
    if len(value) == 1:
        (tag, x), = value.items()
        if tag == "$oid" or tag == "$numberDecimal":
            return x
        if tag in ("$numberInt", "$numberLong"):
            return int(x)
        if tag == "$numberDouble":
            return float(x) if str(x) not in ("NaN", "Infinity", "-Infinity") else None
        if tag == "$date":
            ms = int(x["$numberLong"]) if isinstance(x, dict) else x
            if not isinstance(ms, int):
                return ms
            at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)
            return at.strftime("%Y-%m-%dT%H:%M:%S") + (f".{at.microsecond // 1000:03d}" if at.microsecond else "") + "Z"
        if tag == "$undefined":
            return None
        if tag == "$timestamp":
            return {"i": x["i"], "t": x["t"]}
        if tag == "$binary":
            import base64

            return base64.b64decode(x["base64"]).hex()
        if tag == "$regularExpression":
            return x["pattern"]
    return {k: plain(v) for k, v in sorted(value.items())}


@F.pandas_udf(T.StringType())
def plain_json(docs: pd.Series) -> pd.Series:
    return docs.map(lambda d: None if d is None else json.dumps(plain(json.loads(d)), separators=(",", ":"), ensure_ascii=False))


def bridge_micros(ts_ns: Column, ts_us: Column, ts_ms: Column) -> Column:
    """Microseconds since 1970: ns before us before ms; an ms value beyond 1e14 is taken for microseconds."""
    return F.coalesce(F.floor(ts_ns / 1000).cast("bigint"), ts_us.cast("bigint"), F.when(F.abs(ts_ms) > 100_000_000_000_000, ts_ms.cast("bigint")).otherwise((ts_ms * 1000).cast("bigint")))


def interval_lag(now_ms: Column, source_ms: Column) -> Column:
    """Milliseconds that a source lags; never negative, null without a source time."""
    return F.when(source_ms.isNotNull(), F.greatest(F.lit(0).cast("bigint"), (now_ms - source_ms).cast("bigint")))
