"""Partial JSON updates: path diffs applied to the document before."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([A-Za-z_$][\w$]*))|\[(\d+)\]')


def steps(path: str) -> list[str | int]:
    if not path.startswith("$"):
        raise ValueError(path)
    out, at = [], 1
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(path)
        out.append(int(m[3]) if m[3] is not None else json.loads(f'"{m[1]}"') if m[1] is not None else m[2])
        at = m.end()
    return out


def apply_diffs(base: str | None, diffs: str | None) -> str | None:
    """The document after ``[{"op": replace|insert|remove, "path": ..., "value": ...}, ...]``; None (unavailable) if any step fails."""
    try:
        doc = json.loads(base)
        for d in json.loads(diffs):
            path = steps(d["path"])
            if not path:
                if d["op"] != "replace":
                    return None
                doc = d["value"]
                continue
            at = doc
            for s in path[:-1]:
                at = at[s]
            last = path[-1]
            if isinstance(at, dict) != isinstance(last, str):
                return None
            if d["op"] == "insert" and isinstance(at, list):
                at.insert(last, d["value"])
            elif d["op"] == "insert":
                if last in at:
                    return None
                at[last] = d["value"]
            elif d["op"] == "replace":
                at[last]  # it must be there
                at[last] = d["value"]
            elif d["op"] == "remove":
                del at[last]
            else:
                return None
        return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)
    except (TypeError, ValueError, KeyError, IndexError):
        return None


@F.pandas_udf(T.StringType())
def json_after(base: pd.Series, diffs: pd.Series) -> pd.Series:
    return pd.Series([apply_diffs(b, d) for b, d in zip(base, diffs, strict=True)], dtype=object)
