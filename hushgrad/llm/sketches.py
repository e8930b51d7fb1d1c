"""Shingle sets of texts, their SetSketch registers, and similarity estimates by likelihood."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

WORDS = 5
#: 40 bands of 4 registers: two sets of similarity 0.75 share no band with a probability of 3e-7 at most.
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: The base of the registers' exponential spacing, the rate of the values, and the largest register.
BASE, RATE, TOP = 1.1, 20.0, 255
_BLOCK = 512


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of five words; of fewer words, one of them all."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    n = len(h) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for k in range(WORDS):
        s = (s ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


@lru_cache(maxsize=1)
def _lanes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240101)
    return rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def registers(s: np.ndarray) -> bytes:
    """Register i: how far the smallest of the set's i-th exponential values lies below 1, in powers of the base."""
    a, b = _lanes()
    x = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), _BLOCK):
        v = x[k : k + _BLOCK, None] * a
        v += b
        np.minimum(least, v.min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype(np.uint8).tobytes()


def estimated(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, points: int = 101) -> np.ndarray:
    """The similarity of the greatest likelihood, given set sizes and how many registers of a are above and below b's."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, points)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    like = more[:, None] * log(up) + less[:, None] * log(down) + (REGISTERS - more - less)[:, None] * log(1 - up - down)
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], 1)[:, 0]
