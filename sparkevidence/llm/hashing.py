"""Vectorised hashes of words, shingles and byte strings in numpy (64-bit wrap-around arithmetic)."""

from __future__ import annotations

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Each byte value stands for a random-looking 64-bit number in the rolling hashes.
BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            tables = []
            for b in (base, inverse):
                steps = np.full(size, b & _MASK, U)
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
        _powers[base] = (tables[0], tables[1])
    return _powers[base]


class Rolling:
    """Polynomial prefix hashes of bytes, or of 64-bit codes: span(a, b) hashes data[a:b] for arrays a, b, whatever their position."""

    def __init__(self, data: np.ndarray, base: int = BASE) -> None:
        self.up, down = _power_tables(base, len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((BYTE_CODES[data] if data.dtype == np.uint8 else data) * down[: len(data)], out=self.prefix[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[b] - self.prefix[a]) * self.up[a]


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, A-Z lower-cased, and where each row's words start (one more for the end)."""
    low = LOWER[data]
    inside = ~separator[low]
    if not len(low):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    begins = inside & edge[:-1]
    begins[1:] |= inside[1:] & ~inside[:-1]
    ends = inside & edge[1:]
    ends[:-1] |= inside[:-1] & ~inside[1:]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        hashes = mix(Rolling(low).span(a, b) + (b - a).astype(U) * U(BASE2))
    return hashes, np.searchsorted(a, offsets, "left")


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a row's k-word shingles; a shorter row has its whole sequence as one shingle, none if empty."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    m = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - m + 1, m, U)
        for j in range(m):
            h = h * U(BASE) + words[j : n - m + 1 + j]
    h = np.sort(mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
