"""Hashed byte n-grams over whole columns of text, without a Python loop over characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18


def folding(punctuation_to_space: bool) -> np.ndarray:
    """256-entry byte map: ASCII letters to lower case, ASCII white space (and punctuation) to a blank."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[0:33] = 32
    if punctuation_to_space:
        for first, last in ((33, 48), (58, 65), (91, 97), (123, 128)):
            fold[first:last] = 32
    return fold


def gram_blocks(data: np.ndarray, orders: range, buckets: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Yield (first position, end, order, bucket ids of the n-grams that start there), block by block.

    The n-grams of a block may reach into the next block or the next text; callers cut
    them at the end of the text.  Memory is bounded by the block, however long a text is.
    """
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    last = orders[-1]
    for first in range(0, len(data), BLOCK):
        end = min(first + BLOCK, len(data))
        part = data[first : min(end + last - 1, len(data))].astype(np.uint32)
        part = np.concatenate([part, np.zeros(end - first + last - 1 - len(part), np.uint32)])
        size = end - first
        h = np.zeros(size, np.uint32)
        for k in range(last):
            h = (h ^ part[k : k + size]) * np.uint32(16777619)
            h ^= h >> np.uint32(13)
            if k + 1 in orders:
                yield first, end, k + 1, ((h * np.uint32(2654435769 + 2 * (k + 1))) >> shift).astype(np.int32)


def spans_in(offsets: np.ndarray, first: int, end: int) -> tuple[int, int]:
    """The texts that overlap byte positions first..end, as a range of indices."""
    lo = int(np.searchsorted(offsets, first, side="right")) - 1
    hi = int(np.searchsorted(offsets, end, side="left"))
    return max(lo, 0), min(hi, len(offsets) - 1)


def mean_rows(data: np.ndarray, offsets: np.ndarray, orders: range, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean of ``rows[bucket]`` over all its n-grams, and how many those are."""
    n = len(offsets) - 1
    sums = np.zeros((n, rows.shape[1]))
    for first, end, order, ids in gram_blocks(data, orders, len(rows)):
        running = np.zeros((end - first + 1, rows.shape[1]))
        np.cumsum(rows[ids], axis=0, dtype=np.float64, out=running[1:])
        lo, hi = spans_in(offsets, first, end)
        a = np.clip(offsets[lo:hi], first, end) - first
        b = np.clip(offsets[lo + 1 : hi + 1] - order + 1, first, end) - first
        b = np.maximum(a, b)
        sums[lo:hi] += running[b] - running[a]
    sizes = np.diff(offsets)
    counts = sum(np.maximum(sizes - k + 1, 0) for k in orders)
    return sums / np.maximum(counts, 1)[:, None], counts
