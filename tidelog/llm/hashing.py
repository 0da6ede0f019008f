"""Vectorised word and shingle hashes of UTF-8 text.

A word's hash is a polynomial in random values of its bytes, taken from prefix sums modulo
2**64 and then mixed, so all words of a text are hashed by a few array operations.
"""

from __future__ import annotations

import functools

import numpy as np

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
SPACES = b" \t\n\x0b\x0c\r"


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        p = np.full(n, base, dtype=np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


@functools.cache
def byte_values(lower: bool) -> np.ndarray:
    """A random value for each byte; with ``lower``, A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    if lower:
        values[65:91] = values[97:123]
    return values


@functools.cache
def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


def word_hashes(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words (runs of bytes other than the six ASCII spaces)."""
    whole = np.frombuffer(data, dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(whole):
        cut = len(whole)
        if cut - at > PIECE:
            spaces = np.flatnonzero(_is_space()[whole[at : at + PIECE]])
            cut = at + int(spaces[-1]) + 1 if len(spaces) else next((i + 1 for i in range(at + PIECE, len(whole)) if _is_space()[whole[i]]), len(whole))
        b = whole[at:cut]
        inside = ~_is_space()[b]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(max(PIECE, 1 << (len(b) - 1).bit_length()))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte_values(lower)[b] * power[: len(b)], dtype=np.uint64)))
        hashes.append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = cut
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of fewer words, of the whole sequence; of none, empty."""
    n = min(k, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    return np.unique(mix(h))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The shingle set of each text."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            h, at = word_hashes(b"\n".join(group))
            cut = np.searchsorted(at, np.cumsum([0, *(len(g) + 1 for g in group)]))
            out.extend(shingles(h[a:b], k) for a, b in zip(cut[:-1], cut[1:], strict=True))
        group.clear()
        size = 0

    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if size + len(data) > PIECE:
            flush()
        group.append(data)
        size += len(data)
    flush()
    return out
