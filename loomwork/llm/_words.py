"""Vectorised words and rolling hashes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes of text that are hashed at once; a longer text is taken alone.
SLICE = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[_SPACE] = 0
_P = U(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = [np.ones(1, U)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        x = np.full(max(n, SLICE // 64), _P)
        x[0] = 1
        _POWERS[0] = np.multiply.accumulate(x)
    return _POWERS[0][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(keys: list, texts: list[str | None]) -> Iterator[tuple[list, list[bytes]]]:
    """Keys and texts (UTF-8; null: empty) in runs of about SLICE bytes."""
    ks, ts, n = [], [], 0
    for k, t in zip(keys, texts, strict=True):
        b = (t or "").encode("utf-8", "surrogatepass")
        if ts and n + len(b) > SLICE:
            yield ks, ts
            ks, ts, n = [], [], 0
        ks.append(k)
        ts.append(b)
        n += len(b)
    if ts:
        yield ks, ts


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the index of each word's text.

    Words are runs of bytes other than space and 0x09 to 0x0D.
    """
    buf = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    if lower:
        buf = _LOWER[buf]
    space = _SPACE[buf]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
    place = np.cumsum(space) * 0  # position of each byte in its word
    place[starts] = starts
    at = np.arange(len(buf)) - np.maximum.accumulate(place)
    del place
    at[space] = 0
    longest = int((ends - starts).max()) if len(starts) else 1
    value = _BYTE[buf] * _powers(longest)[at]
    h = np.add.reduceat(value, starts) if len(starts) else np.zeros(0, U)
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    return mix(h + (ends - starts).astype(U)), np.searchsorted(begins, starts, "right") - 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; runs that cross texts too."""
    n = max(0, len(h) - k + 1)
    g = np.full(n, U(k))
    for i in range(k):
        g = (g ^ h[i : i + n]) * _P
        g ^= g >> U(29)
    return mix(g)
