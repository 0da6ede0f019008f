"""Quality classifier by importance resampling.

Two hashed n-gram models, one of a target (documents labelled good), one of all raw
text, give each document a log ratio, its importance weight. Gumbel noise from a hash of
the id is added, and the k documents with the largest sums are kept: a sample without
replacement in proportion to the weights, the same on every run.

Tokens are runs of letters and digits, and runs of other visible characters, case kept;
features are tokens and pairs of neighbours (a token repeated at once is one feature of its own).
Documents are joined for speed only: no pair reaches over the end of a document.

The target model reads a bounded sample of labelled documents (``sample``); the raw model
counts all documents, as sums by bucket that are combined on the map side. ``k`` follows
from the share of documents of quality 1 among labelled ones. The k-th largest key is found by
counting bins three times, then ordering the few rows of one small bin.

Defined cases. A document is an id and a text: rows alike in both share a verdict and count
once, rows of one id (or of a null id) with different texts are documents of their own. A
null or empty text has log ratio 0. Without a usable label nothing is known about the
target: all weights are 0 and everything is kept. Ties go to the smaller id, then to the
smaller hash of the text; a null id sorts last. Columns named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_columns, id_order, materialize, text_or_empty
from .hashing import byte_values, mix

BITS = 14
SAMPLE = 5_000
SMOOTHING = 1.0
PIECE = 1 << 20
ADDED = ["log_ratio", "gumbel_key", "kept"]


def _kinds() -> np.ndarray:
    """By byte: 0 white space or control, 1 letter, digit or part of a longer character, 2 other."""
    kind = np.full(256, 2, np.uint8)
    kind[:33], kind[127], kind[128:] = 0, 0, 1
    for a, b in ((48, 58), (65, 91), (97, 123)):
        kind[a:b] = 1
    return kind


def features(data: bytes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of tokens and pairs, and the first byte of each; ``begin`` has the first byte of each document."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _kinds()[b]
    new = np.concatenate(([True], kind[1:] != kind[:-1]))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(b))
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    power = np.multiply.accumulate(np.where(np.arange(len(b)) == 0, np.uint64(1), np.uint64(0x9E3779B97F4A7C15)))
    back = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    inverse = np.multiply.accumulate(np.where(np.arange(len(b)) == 0, np.uint64(1), np.uint64(back)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte_values(False)[b] * power, dtype=np.uint64)))
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    pair = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    pair[h[:-1] == h[1:]] = np.uint64(1) << np.uint64(63)
    of = np.searchsorted(begin, starts, side="right")
    inside = of[1:] == of[:-1]
    at = np.concatenate((starts, starts[1:][inside]))
    return (np.concatenate((h, pair[inside])) >> np.uint64(64 - BITS)).astype(np.int64), at


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, bytes]]:
    """Texts joined to pieces of bounded size (a longer text is cut): their numbers, where they start, and the bytes."""
    held, numbers, size = [], [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(len(data), 1), PIECE):
            part = data[at : at + PIECE]
            if size + len(part) > PIECE and held:
                yield numbers, np.cumsum([0, *(len(x) + 1 for x in held)]), b"\n".join(held)
                held, numbers, size = [], [], 0
            held.append(part)
            numbers.append(i)
            size += len(part)
    if held:
        yield numbers, np.cumsum([0, *(len(x) + 1 for x in held)]), b"\n".join(held)


def ngram_counts(docs: DataFrame, good: list[int], id_col: str, text_col: str) -> np.ndarray:
    """Counts by bucket, of all documents and of the good ones."""
    known = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(good, np.int64)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            is_good = np.isin(batch["__tl_id"].to_numpy(), known.value)
            for numbers, begin, data in _pieces(list(batch["__tl_text"])):
                bucket, at = features(data, begin)
                total[0] += np.bincount(bucket, minlength=1 << BITS)
                of = np.array(numbers)[np.searchsorted(begin, at, side="right") - 1]
                total[1] += np.bincount(bucket[is_good[of]], minlength=1 << BITS)
        kind, at = np.nonzero(total)
        yield pd.DataFrame({"kind": kind, "at": at, "n": total[kind, at]})

    rows = docs.select(id_order(F.col(id_col)).alias("__tl_id"), F.col(text_col).cast("string").alias("__tl_text"))
    sums = rows.mapInPandas(count, "kind bigint, at bigint, n bigint").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, 1 << BITS), np.float64)
    out[sums["kind"].to_numpy(np.int64), sums["at"].to_numpy(np.int64)] = sums["n"].to_numpy(np.float64)
    return out


def importance_resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, k: int | None = None, seed: int = 17) -> DataFrame:
    """``docs`` with ``log_ratio``, ``gumbel_key`` and ``kept``; ``labels`` has doc_id, quality, toxic."""
    spark = docs.sparkSession
    is_good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    good = [r[0] for r in labels.filter(is_good & F.col("doc_id").isNotNull()).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").select("doc_id").limit(sample).collect()]
    share = labels.filter(F.col("quality").isNotNull()).agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    counts = ngram_counts(docs, good, id_col, text_col)
    usable = bool(good) and counts[1].sum() > 0
    model = counts + SMOOTHING
    model /= model.sum(axis=1, keepdims=True)
    ratio = np.log(model[1] / model[0]) if usable else np.zeros(1 << BITS)
    shared = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def log_ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts))
            for numbers, begin, data in _pieces(list(texts)):
                bucket, at = features(data, begin)
                np.add.at(out, numbers, np.bincount(np.searchsorted(begin, at, side="right") - 1, weights=shared.value[bucket], minlength=len(numbers))[: len(numbers)])
            yield pd.Series(out)

    docs = drop_columns(docs, ADDED)
    key = {"__tl_i": id_order(F.col(id_col)), "__tl_row": F.xxhash64(text_or_empty(text_col))}
    uniform = (F.pmod(F.xxhash64(F.lit(seed + 1), "__tl_i", "__tl_row"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = docs.select(*[c.alias(n) for n, c in key.items()], F.round(log_ratio(F.col(text_col).cast("string")), 6).alias("log_ratio"))
    scored = scored.groupBy("__tl_i", "__tl_row").agg(F.max("log_ratio").alias("log_ratio"))
    keys = materialize(scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(uniform))), "keys")
    n = keys.count()
    k = (round(n * share) if usable and share is not None else n) if k is None else k
    kept = F.lit(True)
    if k < n:
        cut = kth_largest(keys, k)
        i, h = F.col("__tl_i"), F.col("__tl_row")
        kept = F.lit(False) if cut is None else (F.col("gumbel_key") > cut[0]) | ((F.col("gumbel_key") == cut[0]) & ((i < cut[1]) | ((i == cut[1]) & (h <= cut[2]))))
    decided = keys.withColumn("kept", kept)
    return docs.withColumns(key).join(decided, ["__tl_i", "__tl_row"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED)


def kth_largest(keys: DataFrame, k: int) -> tuple[float, int, int] | None:
    """The (key, id, hash) of the k-th row by key descending, then id and hash ascending.

    Bins are counted, then finer ones of the bin that holds the k-th row, until few rows are left to order.
    """
    if k <= 0:
        return None
    rows, left = keys, k
    place = F.asinh("gumbel_key") * 64
    finer = lambda x: (x - F.floor(x)) * 4096
    for at in (F.floor(place), F.floor(finer(place)), F.floor(finer(finer(place)))):
        bins = rows.groupBy(at.alias("b")).count().orderBy(F.col("b").desc()).collect()  # some thousand bins at most
        for b in bins:
            if b["count"] >= left:
                break
            left -= b["count"]
        rows = rows.filter(at == b["b"])
    last = rows.orderBy(F.col("gumbel_key").desc(), "__tl_i", "__tl_row").limit(left).orderBy("gumbel_key", F.col("__tl_i").desc(), F.col("__tl_row").desc()).first()
    return last["gumbel_key"], last["__tl_i"], last["__tl_row"]
