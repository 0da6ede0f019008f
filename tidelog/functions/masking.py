"""Column masking: rules are resolved against a schema on the driver, then applied as expressions.

Rules are ordered truncate, mask, hash v1, hash v2, then as declared; the first that
matches a column wins. Selectors are case-insensitive regular expressions that must match
the whole of ``namespace.table.column`` (any of the source's names for the table).
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIORITY = {"truncate": 0, "mask": 1, "hash_v1": 2, "hash_v2": 3}
#: Hash algorithms by their common names.
NATIVE = {"MD5": "md5", "SHA-1": "sha1", "SHA-224": "224", "SHA-256": "256", "SHA-384": "384", "SHA-512": "512"}
BY_LIBRARY = {"SHA-512/224": "sha512_224", "SHA-512/256": "sha512_256", "SHA3-224": "sha3_224", "SHA3-256": "sha3_256", "SHA3-384": "sha3_384", "SHA3-512": "sha3_512"}
OWN = {"MD2"}


@dataclass(frozen=True)
class Rule:
    selector: str
    kind: str  # truncate, mask, hash_v1, hash_v2
    length: int | None = None
    algorithm: str | None = None
    salt: str = ""

    def __post_init__(self):
        if self.kind not in PRIORITY:
            raise ValueError(f"unknown rule: {self.kind}")
        if self.kind.startswith("hash") and self.algorithm not in {*NATIVE, *BY_LIBRARY, *OWN}:
            raise ValueError(f"unknown hash algorithm: {self.algorithm}")
        re.compile(self.selector)


def ordered(rules: Iterable[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: PRIORITY[r.kind])


def candidates(family: str, database: str, schema: str | None, table: str, column: str) -> list[str]:
    """The names under which a selector may know a column."""
    if family in ("postgresql", "oracle"):
        return [f"{schema}.{table}.{column}"]
    if family == "sqlserver":
        return [f"{database}.{schema}.{table}.{column}", f"{schema}.{table}.{column}"]
    return [f"{database}.{table}.{column}"]


def rule_for(rules: Sequence[Rule], names: Sequence[str]) -> Rule | None:
    return next((r for r in ordered(rules) if any(re.fullmatch(r.selector, n, re.IGNORECASE) for n in names)), None)


def base_type(source_type: str) -> str:
    """A declared type without length, schema prefix and quotes, in lower case."""
    name = re.sub(r"\s*\(.*?\)", "", source_type.strip().lower()).split(".")[-1]
    return name.strip().strip('"`[]')


def is_character(source_type: str) -> bool:
    if source_type.strip().endswith("[]"):
        return False
    return base_type(source_type) in {"char", "character", "character varying", "varchar", "varchar2", "nvarchar", "nvarchar2", "nchar", "bpchar", "text", "ntext", "tinytext", "mediumtext", "longtext", "clob", "nclob", "citext", "name", "enum", "set", "xml"}


def declared_length(source_type: str) -> int | None:
    found = re.search(r"\(\s*(\d+)\s*\)", source_type)
    return int(found[1]) if found else None


def java_string(text: str) -> bytes:
    """A string as Java's object stream writes it."""
    units = text.encode("utf-16-be", "surrogatepass")
    body = b""
    for i in range(0, len(units), 2):
        u = units[i] << 8 | units[i + 1]
        body += bytes([u]) if 0 < u < 0x80 else bytes([0xC0 | u >> 6, 0x80 | u & 0x3F]) if u < 0x800 else bytes([0xE0 | u >> 12, 0x80 | u >> 6 & 0x3F, 0x80 | u & 0x3F])
    head = b"\x74" + len(body).to_bytes(2, "big") if len(body) <= 0xFFFF else b"\x7c" + len(body).to_bytes(8, "big")
    return b"\xac\xed\x00\x05" + head + body


def md2(data: bytes) -> str:
    """The MD2 digest (RFC 1319). Its substitution table has 256 entries and is made by its rule: a shuffle by the digits of pi."""
    table = _pi_table()
    pad = 16 - len(data) % 16
    data += bytes([pad]) * pad
    check, last = bytearray(16), 0
    for at in range(0, len(data), 16):
        for i in range(16):
            check[i] ^= table[data[at + i] ^ last]
            last = check[i]
    state = bytearray(48)
    for block in (*(data[i : i + 16] for i in range(0, len(data), 16)), bytes(check)):
        for i in range(16):
            state[16 + i], state[32 + i] = block[i], block[i] ^ state[i]
        t = 0
        for rnd in range(18):
            for i in range(48):
                state[i] ^= table[t]
                t = state[i]
            t = (t + rnd) % 256
    return bytes(state[:16]).hex()


@functools.cache
def _pi_table() -> list[int]:
    """A permutation of 0..255 by a Durstenfeld shuffle whose random numbers are the decimal digits of pi."""
    digits = iter(_pi_digits(3_000))

    def below(n: int) -> int:
        x, y = next(digits), 10
        if n > 10:
            x, y = x * 10 + next(digits), 100
        if n > 100:
            x, y = x * 10 + next(digits), 1000
        return x % n if x < n * (y // n) else below(n)

    s = list(range(256))
    for i in range(2, 257):
        j = below(i)
        s[j], s[i - 1] = s[i - 1], s[j]
    return s


def _pi_digits(n: int) -> list[int]:
    one = 10 ** (n + 10)

    def arctan(x: int) -> int:
        total = term = one // x
        k, sign = 3, -1
        while term:
            term //= x * x
            total += sign * (term // k)
            k, sign = k + 2, -sign
        return total

    pi = 4 * (4 * arctan(5) - arctan(239))
    return [int(d) for d in str(pi)[:n]]


def digest(algorithm: str, data: bytes) -> str:
    if algorithm == "MD2":
        return md2(data)
    name = BY_LIBRARY.get(algorithm) or algorithm.replace("-", "").lower()
    return hashlib.new(name, data).hexdigest()


def hash_column(c: Column, algorithm: str, salt: str, version: int, length: int | None) -> Column:
    """Hex of H(salt and value), cut to ``length``; null stays null.

    Version 2 hashes the UTF-8 text: in the JVM for the common algorithms. Version 1 hashes
    Java's serialised form: in the JVM for short ASCII texts, where that is a fixed head and the text.
    """
    text = c.cast("string")
    if algorithm in NATIVE:
        body = F.encode(text, "UTF-8")
        if version == 1:
            n = F.octet_length(text)
            body = F.concat(F.lit(bytearray(b"\xac\xed\x00\x05\x74")), F.unhex(F.lpad(F.hex(n.cast("bigint")), 4, "0")), body)
        data = F.concat(F.lit(bytearray(salt.encode())), body)
        name = NATIVE[algorithm]
        hashed = F.md5(data) if name == "md5" else F.sha1(data) if name == "sha1" else F.sha2(data, int(name))
        if version == 1:
            simple = (F.octet_length(text) == F.char_length(text)) & (F.octet_length(text) <= 0xFFFF) & ~text.contains("\x00")
            hashed = F.when(text.isNull() | simple, hashed).otherwise(_by_library(algorithm, salt, 1)(text))
    else:
        hashed = _by_library(algorithm, salt, version)(text)
    return F.substring(hashed, 1, length) if length else hashed


def _by_library(algorithm: str, salt: str, version: int):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        encode = java_string if version == 1 else lambda t: t.encode("utf-8", "surrogatepass")
        return texts.map(lambda t: None if t is None else digest(algorithm, salt.encode() + encode(t)))

    return run


def masked(c: Column, rule: Rule, source_type: str) -> Column:
    """A column under its rule. A mask replaces null too; truncation and hashes keep it."""
    if rule.kind == "truncate":
        return F.substring(c, 1, rule.length) if is_character(source_type) or base_type(source_type) in BINARY_TYPES else c
    if not is_character(source_type):
        return c
    if rule.kind == "mask":
        return F.lit("*" * rule.length)
    return hash_column(c, rule.algorithm, rule.salt, 1 if rule.kind == "hash_v1" else 2, rule.length or declared_length(source_type))


BINARY_TYPES = {"bytea", "binary", "varbinary", "blob", "tinyblob", "mediumblob", "longblob", "image", "raw"}


def mask_image(image: str, fields: dict[str, str], rules: Sequence[Rule], family: str, database: str, schema: str | None, table: str) -> Column:
    """A struct column with its fields masked; ``fields`` maps names to declared types."""
    out = F.col(image)
    for name, source_type in fields.items():
        rule = rule_for(rules, candidates(family, database, schema, table, name))
        if rule:
            out = out.withField(name, masked(F.col(image)[name], rule, source_type))
    return F.when(F.col(image).isNotNull(), out)
