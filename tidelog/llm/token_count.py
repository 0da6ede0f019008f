"""Token counts with a whole-token shortcut.

A byte-level BPE vocabulary is proved once: a vocabulary string that the library encodes
alone to exactly its own id is one token wherever it is a pre-token. Texts are split into
pre-tokens; those in the proved set count 1 by a dictionary lookup, and only the rest go
to the library to be merged (each once, the counts are remembered in a bounded cache).

The split uses the pre-tokenizer's own pattern with its character classes spelled out
for a stated alphabet (below U+0250, and common punctuation), where they are known to
agree with the library's. A text with other characters is first cut where the pattern
must cut whatever their classes: between a character that is no blank and an ASCII blank.
Segments within the alphabet are split here; the others, a word or so in most scripts, are
looked up whole, in the proved set first, and go to the library only if they are not there.

Defined cases. A null text is empty and has no token. Special strings inside a text are
matched as the library does by default. Memory follows one text, not the table.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_columns, text_or_empty

#: Pre-tokens remembered by a worker; beyond that the cache starts anew.
CACHE = 400_000
LONGEST_CACHED = 48
SAFE = re.compile("[\\x00-\\u024f\\u2010-\\u2027\\u20ac]*")
#: Characters that are, or once were, blanks in Unicode; and the place between anything else and an ASCII blank.
BLANKS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u2064\\u3000\\ufeff"
BORDER = re.compile(f"(?<=[^{BLANKS}])(?=[\\t-\\r ])")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _class(wanted: str) -> str:
    """The characters of the safe alphabet in a general category, as regex ranges."""
    points = [c for c in (*range(0x250), *range(0x2010, 0x2028), 0x20AC) if unicodedata.category(chr(c)).startswith(wanted)]
    out, start = [], None
    for c, after in zip(points, [*points[1:], None], strict=True):
        start = c if start is None else start
        if after != c + 1:
            out.append(f"\\u{start:04x}-\\u{c:04x}")
            start = None
    return "".join(out)


@functools.cache
def splitter() -> re.Pattern:
    letters, numbers, space = _class("L"), _class("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


def pretokens(text: str) -> list[str]:
    """Pieces that the library encodes independently of each other: pre-tokens, or whole segments outside the safe alphabet."""
    if SAFE.fullmatch(text):
        return splitter().findall(text)
    out = []
    for segment in BORDER.split(text):
        if SAFE.fullmatch(segment):
            out += splitter().findall(segment)
        else:
            out.append(segment)
    return out


class Counter(dict):
    """pre-token -> number of tokens; holds the proved vocabulary, and a bounded cache of merged pre-tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.whole = prove(self.tokenizer)
        self.update(self.whole)

    def merged(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, token: str) -> int:
        n = self.merged(token)
        if len(token) <= LONGEST_CACHED:
            if len(self) >= CACHE + len(self.whole):
                self.clear()
                self.update(self.whole)
            self[token] = n
        return n

    def count(self, text: str) -> int:
        parts = self.special_re.split(text) if self.special_re and any(s in text for s in self.special) else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, pretokens(p))) for p in parts)


def prove(tokenizer) -> dict[str, int]:
    """The vocabulary strings that encode alone as the one token they name."""
    from tokenizers import decoders

    level, added = decoders.ByteLevel(), {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    names = {level.decode([name]): i for name, i in tokenizer.get_vocab(with_added_tokens=True).items() if name not in added}
    names = {text: i for text, i in names.items() if text and "�" not in text}
    texts = list(names)
    return {t: 1 for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if e.ids == [names[t]]}


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = 512) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    ``path`` is where the tokenizer's JSON file lies on every worker; by default the installed package is asked there.
    """

    @F.pandas_udf("bigint")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path or default_path()).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    docs = drop_columns(docs, ["n_bytes", "n_tokens", "over_limit"])
    text = text_or_empty(text_col)
    out = docs.withColumns({"n_bytes": F.octet_length(text).cast("bigint"), "n_tokens": n_tokens(text)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
