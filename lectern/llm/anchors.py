"""Content-defined anchors: equal strings of a given length get equal anchors at equal places."""

from __future__ import annotations

import numpy as np

from .rolling import Prefix

#: Places below this many fit beside the hash in one 64-bit key.
PLACE_BITS = 24


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` keys, in three passes."""
    n = len(keys)
    if n < width:
        return keys[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of window starts with one anchor, over texts that lie end to end in ``data``.

    A window is ``length`` bytes inside a text. Its anchor is the gram with the least hash among those in it, the
    leftmost of equals; so where a window recurs, its anchor recurs at the same place in it. Returns, for each
    run: the text, the first start (in the whole array), the number of starts, the anchor's hash, and a hash
    of the run's bytes together with the anchor's place.
    """
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return empty
    sums = Prefix(data)
    at = np.arange(len(data) - gram + 1)
    hashes = sums.of(at, at + gram)
    place = np.uint64((1 << PLACE_BITS) - 1)
    anchor = (window_minima((hashes & ~place) | at.astype(np.uint64), length - gram + 1) & place).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    valid = np.arange(len(anchor)) + length <= ends[owner]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(anchor)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    spot = anchor[first]
    content = sums.of(first, first + count + length - 1) ^ ((spot - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return owner[first], first, count, hashes[spot], content
