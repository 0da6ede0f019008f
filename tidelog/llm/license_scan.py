"""Licence scan: a trained paragraph classifier, confirmed by templates.

A multinomial logistic regression over hashed words and word pairs gives each paragraph
(a line with a word) a licence family or ``unknown``. It is trained here, on variants of
the templates below and, for the unknown class, on a bounded sample of the corpus's own
lines (``sample_paragraphs`` distinct ones out of about ``sample_docs`` documents, the first
``SAMPLE_CHARS`` characters of each); its temperature is set on a fifth of these examples
that training did not see, so that the probability of ``unknown`` is calibrated. A predicted family counts only where the
paragraph shares enough three-word shingles with one of the family's templates.

A notice may be wrapped over many lines, none of which is enough by itself. So the shingles
of a text are also looked up across its line ends; where those of one template lie close
together over more than one line, these lines are joined, then classified and confirmed like
a paragraph, and each of them is reported. Where two families claim a line, that with more of
a template found prevails over mere pieces. A line that is a licence's title counts as it stands.

Prediction is one scan without a shuffle, vectorised over all words of a piece of text.

Defined cases. A null text, or one without a word, has no paragraph. Repeated rows are
scanned alike. Columns named like an added one are replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_columns
from .hashing import PIECE, mix, word_hashes

BITS = 13
UNKNOWN = "unknown"
SAMPLE_DOCS = 1_000
SAMPLE_PARAGRAPHS = 4_000
SAMPLE_CHARS = 2_000
MIN_PROBABILITY = 0.5
MIN_SHARED = 0.6
#: Notices of public licences.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
}
#: Titles, which count only where they are a whole line.
TITLES = {
    "Apache-2.0": ["Apache License", "Apache License 2.0", "Apache License, Version 2.0"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "The BSD License", "New BSD License", "Simplified BSD License"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "The GNU General Public License"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 3", "The GNU Lesser General Public License"],
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0"],
}
#: Everything but letters, digits, line ends and bytes of longer characters separates words.
PLAIN = bytes(c if c == 10 or c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass
class Model:
    families: list[str]  # the last one is UNKNOWN
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def paragraph_features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and pairs, the line of each, the number of words by line, and where lines start."""
    h, at = word_hashes(data.translate(PLAIN))
    begin = np.concatenate(([0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1))
    line = np.searchsorted(begin, at, side="right") - 1
    pair = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]) if len(h) else h
    inside = line[:-1] == line[1:]
    bucket = np.concatenate((h, pair[inside])) >> np.uint64(64 - BITS)
    return bucket.astype(np.int64), np.concatenate((line, line[:-1][inside])), np.bincount(line, minlength=len(begin)), begin


def probabilities(model: Model, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By line: class probabilities, number of words, first byte."""
    bucket, line, n, begin = paragraph_features(data)
    order = np.argsort(line, kind="stable")
    sums = np.zeros((len(begin), len(model.families)), np.float32)
    if len(order):
        line = line[order]
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        sums[line[first]] = np.add.reduceat(model.weights[bucket[order]], first, axis=0)
    logit = (sums / np.sqrt(np.maximum(2 * n - 1, 1))[:, None] + model.bias) / model.temperature
    logit -= logit.max(axis=1, keepdims=True)
    e = np.exp(logit)
    return e / e.sum(axis=1, keepdims=True), n, begin


def _variants(template: str, rng: np.random.Generator, n: int) -> list[str]:
    words, out = template.split(), [template]
    for _ in range(n):
        keep = [w for w in words if rng.random() > 0.08] or words
        a = int(rng.integers(0, max(1, len(keep) // 4))) if len(keep) > 10 else 0
        extra = ["Copyright", str(int(rng.integers(1990, 2026)))] if rng.random() < 0.3 else []
        out.append(" ".join([*extra, *keep[a:]]))
    return out


@dataclass
class Examples:
    """Paragraphs as sparse rows: (line, column, value) in the order of lines, and the class of each."""

    line: np.ndarray
    col: np.ndarray
    value: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, samples: list[tuple[str, int]], used: np.ndarray | None = None) -> tuple[Examples, np.ndarray]:
        bucket, line, words, _ = paragraph_features("\n".join(s.replace("\n", " ") for s, _ in samples).encode())
        used = np.unique(bucket) if used is None else used
        col = np.minimum(np.searchsorted(used, bucket), len(used) - 1)
        known = used[col] == bucket
        order = np.argsort(line[known], kind="stable")
        line, col = line[known][order], col[known][order]
        return cls(line, col, (1 / np.sqrt(np.maximum(2 * words - 1, 1)))[line].astype(np.float32), np.array([k for _, k in samples])), used

    def logits(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = np.zeros((len(self.y), w.shape[1]), np.float32)
        if len(self.line):
            first = np.flatnonzero(np.concatenate(([True], self.line[1:] != self.line[:-1])))
            z[self.line[first]] = np.add.reduceat(w[self.col] * self.value[:, None], first, axis=0)
        return z + b

    def dense(self, n: int) -> np.ndarray:
        """As a matrix: the samples are bounded, and so are the columns (2**BITS)."""
        x = np.zeros((len(self.y), n), np.float32)
        np.add.at(x, (self.line, self.col), self.value)
        return x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_paragraphs: int = SAMPLE_PARAGRAPHS, seed: int = 5, templates: dict[str, list[str]] | None = None) -> Model:
    """Learns from variants of ``templates``, and from lines of about ``sample_docs`` documents as the unknown class."""
    templates = TEMPLATES if templates is None else templates
    rng = np.random.default_rng(seed)
    families = [*sorted(templates), UNKNOWN]
    n = docs.count()
    drawn = docs.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(text_col)), F.lit(1_000_003)) < (min(1.0, sample_docs / max(n, 1)) * 1_000_003))
    lines = drawn.select(F.explode_outer(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1)).alias("p")).select(F.substring("p", 1, SAMPLE_CHARS).alias("p")).filter("length(p) >= 3").distinct()
    lines = lines.orderBy(F.xxhash64("p"), "p").limit(sample_paragraphs)
    shingled = [_shingles(t) for f in families[:-1] for t in TEMPLATES[f]]
    other = [r[0] for r in lines.collect() if _title(r[0]) is None and not _confirmed(r[0], shingled, piece=True)]
    other += ["the use of this work is described in the text of the agreement", "this file is part of the program", "version 3 of the software was released", "free to use", "terms and conditions of the service"]
    samples = [(v, k) for k, f in enumerate(families[:-1]) for t in templates[f] for v in _variants(t, rng, 40)] + [(p, len(families) - 1) for p in other]
    samples = [samples[i] for i in rng.permutation(len(samples))]
    cut = len(samples) * 4 // 5
    x, used = Examples.of(samples[:cut])
    y = np.eye(len(families), dtype=np.float32)[x.y]
    w, b = np.zeros((len(used), len(families)), np.float32), np.zeros(len(families), np.float32)
    rate, weight = 2.0, 1.0 / np.maximum(y.sum(axis=0), 1)
    weight = (y @ weight)[:, None] / len(families)
    matrix = x.dense(len(used))
    for _ in range(150):
        g = (softmax(matrix @ w + b) - y) * weight
        w -= rate * 10 * (matrix.T @ g + 1e-5 * w)
        b -= rate * g.sum(axis=0)
    unseen, _ = Examples.of(samples[cut:], used)
    z = unseen.logits(w, b)
    loss = {t: -float(np.log(np.maximum(softmax(z / t)[np.arange(len(z)), unseen.y], 1e-30)).sum()) for t in (0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0)}
    full = np.zeros((1 << BITS, len(families)), np.float32)
    full[used] = w
    return Model(families, full, b, min(loss, key=loss.get))


def report(model: Model, cases: list[tuple[str, str]]) -> dict[str, float]:
    """How the classifier alone does on (paragraph, family or ``unknown``): recall and precision of families, calibration error of its first choice."""
    p = probabilities(model, "\n".join(c.replace("\n", " ") for c, _ in cases).encode())[0]
    guess, sure = [model.families[k] for k in p.argmax(axis=1)], p.max(axis=1)
    right = np.array([g == want for g, (_, want) in zip(guess, cases, strict=True)])
    licences, claimed = np.array([want != UNKNOWN for _, want in cases]), np.array([g != UNKNOWN for g in guess])
    bins = np.minimum((sure * 10).astype(int), 9)
    error = sum(abs(sure[bins == k].mean() - right[bins == k].mean()) * (bins == k).mean() for k in range(10) if (bins == k).any())
    return {"recall": float(right[licences].mean()), "precision": float(right[claimed].mean()) if claimed.any() else 1.0, "calibration_error": float(error)}


def _shingles(text: str) -> set[tuple[str, ...]]:
    words = text.lower().encode().translate(PLAIN).split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def _confirmed(paragraph: str, templates: list[set], piece: bool = False) -> bool:
    """Whether the paragraph holds enough of a template, or is itself mostly a piece of one (of any length with ``piece``)."""
    own = _shingles(paragraph)
    return any(len(own & t) >= MIN_SHARED * min(len(own), len(t)) for t in templates if own and t and (piece or len(own) * 4 >= len(t)))


def _title(line: str) -> str | None:
    """The family whose title the line is."""
    return _titles().get(tuple(line.lower().encode().translate(PLAIN).split()))


@functools.cache
def _titles() -> dict[tuple[bytes, ...], str]:
    return {tuple(t.lower().encode().translate(PLAIN).split()): f for f, titles in TITLES.items() for t in titles}


def _triples(h: np.ndarray) -> np.ndarray:
    """Hashes of three neighbouring words each."""
    return mix((h[:-2] * np.uint64(0xD6E8FEB86659FD93) + h[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + h[2:])


@functools.cache
def _template_triples() -> list[tuple[str, int, np.ndarray]]:
    """By template of at least three words: its family, its number among the family's, the sorted hashes of its shingles."""
    hashed = [(f, k, word_hashes(t.encode().translate(PLAIN))[0]) for f, texts in TEMPLATES.items() for k, t in enumerate(texts)]
    return [(f, k, np.unique(_triples(h))) for f, k, h in hashed if len(h) > 2]


def _runs(data: bytes, begin: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, str, int, int, int, int, int]]:
    """Stretches over more than one line of a document that hold enough of a template.

    Gives the number of shingles found, the family, the template's number, the first and last line, and the first and last byte of what was found.
    Shingles that are further apart than a third of the template do not belong together.
    """
    h, at = word_hashes(data.translate(PLAIN))
    if len(h) < 3:
        return
    line = np.searchsorted(begin, at, side="right") - 1
    triple = _triples(h)
    every = np.unique(np.concatenate([t for _, _, t in _template_triples()]))
    hit = np.flatnonzero((every[np.minimum(np.searchsorted(every, triple), len(every) - 1)] == triple) & (doc[line[:-2]] == doc[line[2:]]))
    ends = np.append(at[1:], len(data))
    for family, k, own in _template_triples():
        places = hit[np.isin(triple[hit], own)]
        if not len(places):
            continue
        apart = (np.diff(places) > max(3, len(own) // 3)) | np.diff(doc[line[places]]).astype(bool)
        for run in np.split(places, np.flatnonzero(apart) + 1):
            first, last = run[0], run[-1] + 2
            n = len(np.unique(triple[run]))
            if line[first] < line[last] and n * 4 >= MIN_SHARED * len(own):
                yield n, family, k, int(line[first]), int(line[last]), int(at[first]), int(ends[last])


def license_scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_paragraphs``, ``licenses`` (families confirmed, sorted), ``license_at`` (line numbers) and ``license_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n_paragraphs bigint, licenses array<string>, license_at array<int>, license_score double")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        templates = {f: [_shingles(t) for t in TEMPLATES[f]] for f in known.families[:-1]}
        for texts in batches:
            out, group, size = [], [], 0
            for t in texts:
                data = (t or "").encode("utf-8", "surrogatepass")
                if group and size + len(data) > PIECE:
                    out += _scan(known, templates, group)
                    group, size = [], 0
                group.append(data)
                size += len(data)
            out += _scan(known, templates, group) if group else []
            yield pd.DataFrame(out, columns=["n_paragraphs", "licenses", "license_at", "license_score"])

    docs = drop_columns(docs, ["n_paragraphs", "licenses", "license_at", "license_score", "__tl_l"])
    return docs.withColumn("__tl_l", scan(F.col(text_col).cast("string"))).select(*[F.col(f"`{c}`") for c in docs.columns], "__tl_l.*")


def _scan(model: Model, templates: dict[str, list[set]], group: list[bytes]) -> list[tuple]:
    data = b"\n".join(group)
    p, n, begin = probabilities(model, data)
    first = np.searchsorted(begin, np.cumsum([0, *(len(g) + 1 for g in group)]))
    doc = np.searchsorted(first, np.arange(len(begin)), side="right") - 1
    ends = np.append(begin[1:] - 1, len(data))
    found: dict[tuple[int, str], float] = {}
    pieces: set[tuple[int, str]] = set()
    joined: dict[int, str] = {}

    def text(a: int, b: int) -> str:
        return data[a:b].decode("utf-8", "replace")

    guess = p.argmax(axis=1)
    for line in np.flatnonzero((guess < len(model.families) - 1) & (p.max(axis=1) >= MIN_PROBABILITY) & (n > 0)).tolist():
        family = model.families[guess[line]]
        paragraph = text(begin[line], ends[line])
        if _confirmed(paragraph, templates[family]):
            found[line, family] = float(p[line, guess[line]])
            if not any(len(_shingles(paragraph) & t) >= MIN_SHARED * len(t) for t in templates[family]):
                pieces.add((line, family))
    for line in np.flatnonzero((n > 0) & (n <= max(map(len, _titles())))).tolist():
        family = _title(text(begin[line], ends[line]))
        if family is not None:
            found.setdefault((line, family), float(p[line, model.families.index(family)]))
    for _, family, k, a, b, start, end in sorted(_runs(data, begin, doc), key=lambda r: (-r[0], *r[1:])):
        if any(joined.get(line, family) != family for line in range(a, b + 1)):
            continue
        share = probabilities(model, data[start:end].replace(b"\n", b" "))[0][0]
        if model.families[share.argmax()] != family or share.max() < MIN_PROBABILITY:
            continue
        if _confirmed(text(begin[a], ends[b]), templates[family][k : k + 1]):
            for line in (np.flatnonzero(n[a : b + 1] > 0) + a).tolist():
                joined[line] = family
                found[line, family] = max(found.get((line, family), 0.0), float(share.max()))
    found = {(line, f): x for (line, f), x in found.items() if (line, f) not in pieces or joined.get(line, f) == f}
    words = np.concatenate(([0], np.cumsum(n > 0)))
    by_doc: list[list[tuple]] = [[] for _ in group]
    for (line, family), score in sorted(found.items()):
        by_doc[doc[line]].append((family, line - int(first[doc[line]]), score))
    return [(int(words[b] - words[a]), sorted({f[0] for f in own}), sorted({f[1] for f in own}), max((round(f[2], 6) for f in own), default=0.0)) for own, a, b in zip(by_doc, first[:-1], first[1:], strict=True)]
