"""Vectorised hashes of substrings: many windows of a batch of texts in a few numpy passes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base (or its inverse) modulo 2**64, up to the n-th."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        factors = np.full(size, _BASE if kind == "base" else _INVERSE, np.uint64)
        factors[0] = 1
        have = _powers[kind] = np.multiply.accumulate(factors)
    return have[:n]


def forget() -> None:
    """Drop the tables of powers."""
    _powers.clear()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Hashes of any substrings of one array of symbols, from its prefix sums."""

    def __init__(self, symbols: np.ndarray):
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _power("base", len(symbols)), out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * _power("inverse", len(self.sums))[start] + (stop - start).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words of a byte array: runs of anything but space and the bytes 9 to 13."""
    inner = np.zeros(len(data) + 2, bool)
    inner[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    return edges[::2], edges[1::2]
