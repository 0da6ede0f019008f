"""Chat formatting with an offset-aligned loss mask.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of the
assistant's texts are intersected with the token spans by binary search.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>\\n`` per turn. The three marks
are single special tokens, so a text starts and ends at a token border. Inside roles and
texts every ``<``, any number of backslashes, ``|`` gets one more backslash; reading back
takes one away. That is reversible, and no text can hold a mark.

Plan. One shuffle on the conversation; the
rest is row-wise. A conversation is one row by contract, so a conversation must fit in
memory; the number and skew of conversations do not matter.

Defined cases. A null role or text is empty. Turns are ordered by (turn, role, text), a
null turn first; repeated rows are repeated turns. A null conv_id is one conversation.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .token_count import default_path, pretokens

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.DOTALL)
ESCAPED = re.compile(r"<(\\*)\\\|")
LEARNED_ROLE = "assistant"
#: Pre-tokens that a worker remembers the encoding of, and eight times as many tokens.
REMEMBERED = 400_000


def escape(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def render(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted."""
    turns = conversations.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(f"{END}\n")))
    return turns.select("conv_id", F.array_join(shown, "").alias("formatted"))


class Encoder(dict):
    """pre-token -> its number; ids, starts and ends of all pre-tokens lie end to end in three arrays. A bounded cache.

    Pre-tokens are merged on their own, so a text's encoding is gathered from those of its
    pre-tokens by their numbers, a few array operations a text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([START, SEP, END])
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.ids, self.starts, self.ends, self.begin = array("i"), array("i"), array("i"), array("q", [0])

    def __missing__(self, token: str) -> int:
        e = self.tokenizer.encode(token, add_special_tokens=False)
        offsets = e.offsets
        self.ids.extend(e.ids)
        self.starts.extend([a for a, _ in offsets])
        self.ends.extend([b for _, b in offsets])
        self.begin.append(len(self.ids))
        n = len(self)
        self[token] = n
        return n

    def forget(self) -> None:
        """Between texts, once the cache has grown to its bound."""
        if len(self) > REMEMBERED or len(self.ids) > 8 * REMEMBERED:
            self.clear()
            self.ids, self.starts, self.ends, self.begin = array("i"), array("i"), array("i"), array("q", [0])

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids, and where tokens start and end."""
        self.forget()
        tokens: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                tokens.append(part)
            else:
                tokens += pretokens(part)
        number = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        begin = np.frombuffer(self.begin, np.int64)
        first = begin[number]
        n = begin[number + 1] - first
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        base = np.repeat(np.cumsum(sizes) - sizes, n).astype(np.int32)
        ids, starts, ends = (np.frombuffer(flat, np.int32)[at] if len(at) else np.zeros(0, np.int32) for flat in (self.ids, self.starts, self.ends))
        return ids, starts + base, ends + base


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for tokens that overlap a span; token and text spans are sorted."""
    mask = np.zeros(len(starts) + 1, dtype=np.int32)
    if spans and len(starts):
        s = np.asarray([x for x in spans if x[0] < x[1]], dtype=np.int64).reshape(-1, 2)
        np.add.at(mask, np.searchsorted(ends, s[:, 0], side="right"), 1)
        np.add.at(mask, np.searchsorted(starts, s[:, 1], side="left"), -1)
    return (np.cumsum(mask[:-1]) > 0).astype(np.int8)


def chat_format(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, formatted, token_ids, token_starts, token_ends (code points), loss_mask."""

    @F.pandas_udf("token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<tinyint>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens = encoder(path or default_path())
        for texts in batches:
            rows = []
            for text in texts:
                ids, starts, ends = tokens.encode(text)
                spans = [m.span(2) for m in TURN.finditer(text) if unescape(m[1]) == LEARNED_ROLE]
                rows.append((ids, starts, ends, loss_mask(starts, ends, spans)))
            yield pd.DataFrame(rows, columns=["token_ids", "token_starts", "token_ends", "loss_mask"])

    return render(conversations).withColumn("__tl_e", encode("formatted")).select("conv_id", "formatted", "__tl_e.*")


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts of runs of masked tokens, unescaped."""
    on = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8)))
    return [unescape(text[starts[a] : ends[b - 1]]) for a, b in zip(on[::2], on[1::2], strict=True)]


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of ``chat_format`` says: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    @F.pandas_udf("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    def parse(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, starts, ends, mask in zip(*batch, strict=True):
                turns = [(unescape(r), unescape(t)) for r, t in TURN.findall(text)]
                loss = "".join(masked_texts(text, starts, ends, mask))
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.withColumn("__tl_r", parse("formatted", "token_starts", "token_ends", "loss_mask")).select("conv_id", "__tl_r.*")
