"""Language identification of mixed-language text.

Every word gets a score per language from a character-trigram model; the word's script
narrows the candidates to languages seen in it; a Viterbi pass over the words with a
penalty for switching labels spans, and the language with most letters is the text's.

Training reads a bounded sample (``sample_per_lang`` documents a language, about), drawn
by a hash of the id from all labelled documents outside the held-out part; its trigram
counts are summed on the cluster and the model is languages x 65,536 numbers, which the
workers share; so there may be ``MAX_LANGS`` labels (64 MB), and more of them are an error.

Prediction is one scan without a shuffle. Texts are scored in pieces of bounded length,
vectorised over all letters of a piece; the Viterbi pass steps through the words of many
texts side by side.

Defined cases. A null text, or one without a letter, is ``und`` with score 0 and no
span. With nothing to learn from, everything is ``und``. Ties go to the language that
sorts first. Repeated rows are predicted alike. Columns named like an added one are replaced.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_columns

BITS = 16
SWITCH = 12.0
SMOOTHING = 0.5
SAMPLE_PER_LANG = 2_000
#: Labels that a model may have.
MAX_LANGS = 256
#: Letters scored at once.
PIECE = 1_000_000
UNKNOWN = "und"
ADDED = ["lang_pred", "score", "span_ends", "span_langs", "known_share"]
#: First code points of blocks, and the script that starts there (0: common).
SCRIPTS = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00AA, 1), (0x0250, 1), (0x0300, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5),
    (0x0600, 6), (0x0700, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 11), (0x0B80, 12), (0x0C00, 13), (0x0C80, 14), (0x0D00, 15), (0x0D80, 16),
    (0x0E00, 17), (0x0E80, 18), (0x0F00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 0), (0x1780, 24), (0x1800, 25), (0x18B0, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x3040, 26), (0x30A0, 26), (0x3100, 0), (0x3400, 27), (0xA000, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 27), (0xFB00, 0), (0x20000, 27), (0x32000, 0),
]
N_SCRIPTS = 28


def is_held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, whether it belongs to a word, its script."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x32400)] + [""] * (0x110000 - 0x32400)
    letter = np.fromiter((k == "L" for k in kinds), dtype=bool, count=0x110000)
    word = np.fromiter((k in ("L", "M") for k in kinds), dtype=bool, count=0x110000)
    script = np.zeros(0x110000, dtype=np.uint8)
    for (a, s), b in zip(SCRIPTS, [*(x[0] for x in SCRIPTS[1:]), 0x110000], strict=True):
        script[a:b] = s
    return letter, word, script


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


@dataclass
class Words:
    """The words of a piece of text, and the trigrams of their letters."""

    starts: np.ndarray
    ends: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    first: np.ndarray
    grams: np.ndarray


def words_of(text: str) -> Words:
    letter, word, script = tables()
    points = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = word[points]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    z = np.concatenate(([32], np.where(inside, points, 32), [32])).astype(np.uint64)
    at = np.flatnonzero(inside)
    h = (z[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (z[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (z[at + 2] * np.uint64(0x165667B19E3779F9))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    first = np.concatenate(([0], np.cumsum(ends - starts)[:-1])).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    n = np.add.reduceat(letter[points[at]].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return Words(starts, ends, n, script[points[starts]] if len(starts) else np.zeros(0, np.uint8), first, (h >> np.uint64(64 - BITS)).astype(np.int64))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # trigram x language, log probabilities
    allowed: np.ndarray  # script x language
    seen: np.ndarray  # scripts that some language uses; words of others may be of any

    def scores(self, w: Words) -> np.ndarray:
        if not len(w.starts):
            return np.zeros((0, len(self.langs)), np.float32)
        s = np.add.reduceat(self.weights[w.grams], w.first, axis=0)
        return np.where(self.allowed[w.script], s, s - np.float32(1e6))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learns from about ``sample_per_lang`` documents a language, none of them held out."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(is_held_out(id_col), F.lit(False)))
    n = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().limit(MAX_LANGS + 1).collect()}
    if len(n) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not n:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool), np.zeros(N_SCRIPTS, bool))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, k in n.items() for x in (lang, min(1.0, sample_per_lang / k))]), F.col(lang_col))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1_000_003)) < share * 1_000_003).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                total = seen.setdefault(lang, np.zeros((1 << BITS) + N_SCRIPTS, np.int64))
                for piece in pieces(text):
                    w = words_of(piece)
                    total[: 1 << BITS] += np.bincount(w.grams, minlength=1 << BITS)
                    total[1 << BITS :] += np.bincount(w.script, weights=w.letters, minlength=N_SCRIPTS).astype(np.int64)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "at": at, "n": total[at]})

    sums = drawn.mapInPandas(count, "lang string, at bigint, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros(((1 << BITS) + N_SCRIPTS, len(langs)), np.float64)
    counts[sums["at"].to_numpy(np.int64), np.searchsorted(langs, sums["lang"].to_numpy(str))] = sums["n"].to_numpy()
    grams, script = counts[: 1 << BITS] + SMOOTHING, counts[1 << BITS :]
    allowed = script >= 0.001 * np.maximum(script.sum(axis=0), 1)
    seen = allowed.any(axis=1)
    allowed[~seen] = True
    return Model(langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed, seen)


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``PIECE`` characters, cut at white space where there is some."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
        cut = cut if cut > at else at + PIECE
        yield text[at:cut]
        at = cut
    yield text[at:]


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best labels of each sequence; sequences advance side by side."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lens = np.array([len(scores[i]) for i in order])
    if not len(lens) or not lens[0]:
        return [np.zeros(0, np.int64) for _ in scores]
    flat, base = np.concatenate([scores[i] for i in order]), np.concatenate(([0], np.cumsum(lens)[:-1]))
    n_langs = flat.shape[1]
    came = np.zeros(flat.shape, bool)  # the label was switched to
    best_at = np.zeros(len(flat), np.int32)  # the best label before
    active = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")
    v = flat[base[: active[0]]].astype(np.float64)
    final = np.zeros((len(lens), n_langs))
    for t in range(1, lens[0]):
        k = active[t]
        if k < len(v):
            final[k : len(v)] = v[k:]
            v = v[:k]
        top = v.argmax(axis=1)
        jump = v[np.arange(k), top] - switch
        better = jump[:, None] > v
        at = base[:k] + t
        came[at], best_at[at] = better, top
        v = np.where(better, jump[:, None], v) + flat[at]
    final[: len(v)] = v
    labels, now = np.zeros(len(flat), np.int64), final.argmax(axis=1)
    for t in range(lens[0] - 1, -1, -1):
        k = active[t]
        at = base[:k] + t
        labels[at] = now[:k]
        now[:k] = np.where(came[at, now[:k]], best_at[at], now[:k])
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for i, a, n in zip(order, base, lens, strict=True):
        out[i] = labels[a : a + n]
    return out


def label(texts: list[str], model: Model, switch: float = SWITCH) -> list[tuple[str, float, list[int], list[str], float]]:
    """For each text: language, share of its letters, ends of spans (code points), languages of spans, share of letters in scripts that were learned."""
    n_langs = len(model.langs)
    scores, letters, ends, learned = [], [], [], []
    joined: list[tuple[int, str]] = []
    for i, text in enumerate(texts):
        at = 0
        for piece in pieces(text):
            joined.append((i, at, piece))
            at += len(piece)
    parts: dict[int, list] = {}
    group, size = [], 0

    def flush():
        nonlocal group, size
        if group:
            w = words_of("\n".join(p for _, _, p in group))
            s = model.scores(w)
            begin = np.cumsum([0, *(len(p) + 1 for _, _, p in group)])
            cut = np.searchsorted(w.starts, begin)
            for (i, at, _), a, b, off in zip(group, cut[:-1], cut[1:], begin[:-1], strict=True):
                parts.setdefault(i, []).append((s[a:b], w.letters[a:b], w.ends[a:b] - off + at, w.letters[a:b] * model.seen[w.script[a:b]]))
        group, size = [], 0

    for item in joined:
        if size + len(item[2]) > PIECE:
            flush()
        group.append(item)
        size += len(item[2])
    flush()
    for i in range(len(texts)):
        scores.append(np.concatenate([p[0] for p in parts[i]]))
        letters.append(np.concatenate([p[1] for p in parts[i]]))
        ends.append(np.concatenate([p[2] for p in parts[i]]))
        learned.append(int(sum(p[3].sum() for p in parts[i])))
    out = []
    for path, n, end, known in zip(viterbi(scores, switch) if n_langs else [None] * len(texts), letters, ends, learned, strict=True):
        if path is None or not n.sum():
            out.append((UNKNOWN, 0.0, [], [], 0.0))
            continue
        by = np.bincount(path, weights=n, minlength=n_langs)
        last = np.append(np.flatnonzero(np.diff(path)), len(path) - 1)
        out.append((model.langs[by.argmax()], float(by.max() / by.sum()), end[last].tolist(), [model.langs[k] for k in path[last]], float(known / n.sum())))
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``span_ends``, ``span_langs`` and ``known_share`` (of letters in scripts that the model has learned)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.allowed, model.seen))

    @F.pandas_udf("lang_pred string, score double, span_ends array<int>, span_langs array<string>, known_share double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Model(*shared.value)
        for texts in batches:
            texts, out = ["" if t is None else t for t in texts], []
            group, size = [], 0
            for t in texts:  # a group is as large as memory allows; its longest text sets the number of Viterbi steps
                group.append(t)
                size += len(t)
                if size > 8 * PIECE:
                    out += label(group, known, switch)
                    group, size = [], 0
            out += label(group, known, switch)
            yield pd.DataFrame(out, columns=ADDED)

    docs = drop_columns(docs, [*ADDED, "__tl_l"])
    return docs.withColumn("__tl_l", predict(F.col(text_col).cast("string"))).select(*[F.col(f"`{c}`") for c in docs.columns], "__tl_l.*")
