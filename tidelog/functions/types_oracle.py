"""Oracle literals and redo statements.

Statements are scanned character by character (quotes may hold any text), so this runs
as a vectorised UDF over Arrow batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(text: str):
    """None, text, int, float, or the raw text of anything else (functions are not guessed at)."""
    t = text.strip()
    if t.upper() == "NULL":
        return None
    if len(t) >= 2 and t[0] == t[-1] == "'":
        return t[1:-1].replace("''", "'")
    if re.fullmatch(r"[+-]?\d+", t) and -(2**63) <= int(t) < 2**63:
        return int(t)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", t):
        return float(t)
    return t


def split_outside(text: str, separator: str) -> list[str]:
    """Splits at a separator that is outside quotes and parentheses."""
    out, depth, quoted, start, i = [], 0, False, 0, 0
    while i < len(text):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if not depth and text[i : i + len(separator)].upper() == separator:
                out.append(text[start:i])
                i = start = i + len(separator)
                continue
        i += 1
    return [*out, text[start:]]


def _name(text: str) -> str:
    return text.strip().strip('"')


def parse_redo(sql: str | None) -> dict | None:
    """Columns and values that an INSERT or UPDATE sets, or that a DELETE's predicates name; None for anything else."""
    if not sql:
        return None
    s = sql.strip().rstrip(";")
    if m := re.match(r"(?is)insert\s+into\s+[^(]+\((.*?)\)\s*values\s*\((.*)\)\s*$", s):
        names, values = split_outside(m[1], ","), split_outside(m[2], ",")
        return {_name(n): literal(v) for n, v in zip(names, values, strict=True)} if len(names) == len(values) else None
    if m := re.match(r"(?is)update\s+\S+\s+set\s+(.*)$", s):
        body, _, where = _cut(m[1], " WHERE ")
        out = _predicates(where)
        return out | {_name(a): literal(b) for a, _, b in (p.partition("=") for p in split_outside(body, ","))}
    if m := re.match(r"(?is)delete\s+from\s+(.*)$", s):
        return _predicates(_cut(m[1], " WHERE ")[2])
    return None


def _cut(text: str, word: str) -> tuple[str, str, str]:
    parts = split_outside(text, word)
    return parts[0], word, word.join(parts[1:])


def _predicates(where: str) -> dict:
    out = {}
    for p in split_outside(where, " AND "):
        if m := re.match(r'(?is)\s*("?[\w$#]+"?)\s+is\s+null\s*$', p):
            out[_name(m[1])] = None
        elif "=" in p:
            a, _, b = p.partition("=")
            out[_name(a)] = literal(b)
    return out


@F.pandas_udf(T.StringType())
def redo_json(statements: pd.Series) -> pd.Series:
    """What a redo statement sets, as JSON with its columns in order of name."""
    return statements.map(lambda s: None if (d := parse_redo(s)) is None else json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
