"""Word hashes and shingle hashes of whole texts, in NumPy."""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
EMPTY = np.zeros(0, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(97).integers(0, 1 << 64, 256, dtype=np.uint64)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_BASE, -k, 1 << 64))])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and of its inverse."""
    return _powers.get(n)


def prefix_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n + 1) hashes of the prefixes of n bytes, and the factors that bring a difference of two to its place."""
    up, down = _powers.get(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[b] * up[:-1], out=total[1:])
    return total, down


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text, split at ASCII white space."""
    b = np.frombuffer(raw, np.uint8)
    ink = np.zeros(len(b) + 2, dtype=np.int8)
    ink[1:-1] = ~_WHITE[b]
    step = np.diff(ink)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return EMPTY
    total, down = prefix_hashes(b)
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def lowered(text: str | None) -> np.ndarray:
    """Hashes of the words of a text with A-Z lower-cased."""
    return word_hashes((text or "").encode().lower())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, in order."""
    if len(h) < n:
        return EMPTY
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = out * _P1 + h[i : len(h) - n + 1 + i]
        out ^= out >> np.uint64(31)
    return mixed(out)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """As grams, but fewer than n words are one shingle."""
    return grams(h, min(n, len(h))) if len(h) else EMPTY


class Permutations:
    """Minima of 32-bit hashes under k seeded permutations (xor, then an odd multiplier)."""

    def __init__(self, k: int, seed: int):
        rng = np.random.default_rng(seed)
        self.xor = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        self.odd = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def minima(self, values: np.ndarray, block: int | None = None) -> np.ndarray:
        """(k,) minima of all values, or (k, blocks) minima of consecutive blocks; few rows are permuted at once."""
        x, size = (values >> np.uint64(32)).astype(np.uint32), block or 4096
        rows = size * max(1, 4096 // size)
        parts = []
        for at in range(0, len(x), rows):
            y = (x[at : at + rows, None] ^ self.xor) * self.odd
            parts.append(np.minimum.reduceat(y, np.arange(0, len(y), size), axis=0))
        low = np.concatenate(parts)
        return np.ascontiguousarray(low.T) if block else low.min(axis=0)
