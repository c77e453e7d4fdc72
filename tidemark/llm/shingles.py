"""Weighted word shingles and their ProbMinHash signatures, for whole columns of text in numpy."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import mix64

WORDS = 5
LOW = np.uint64((1 << 48) - 1)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = np.uint64(0x2545F4914F6CDD1D)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (run of bytes that aren't ASCII white space) and its text's index."""
    place = np.flatnonzero(~BLANK[data])
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new = np.ones(len(place), bool)
    new[1:] = np.diff(place) > 1
    edge = offsets[1:-1]
    at = np.searchsorted(place, edge)
    at = at[at < len(place)]
    new[at] = True
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(place)))
    inside = np.arange(len(place)) - np.repeat(starts, length)
    power = np.cumprod(np.full(int(length.max()), STEP, np.uint64))
    sums = np.add.reduceat(BYTE[data[place]] * power[inside], starts)
    return mix64(sums + length.astype(np.uint64)), np.searchsorted(offsets, place[starts], side="right") - 1


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its distinct shingles: (text index, 48-bit hash, count), sorted by text and hash.

    A text of fewer words than a shingle has one shingle, of all its words; one of no words has none.
    """
    h, text = word_hashes(data, offsets)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    firsts = np.flatnonzero(np.diff(text, prepend=-1))
    counts = np.diff(np.append(firsts, len(h)))
    n = len(h) - words + 1
    keys, owner = [], []
    if n > 0:
        whole = np.zeros(n, np.uint64)
        for k in range(words):
            whole = whole * STEP + h[k : k + n]
        inside = text[:n] == text[words - 1 :]
        keys.append(mix64(whole[inside]))
        owner.append(text[:n][inside])
    for k in np.flatnonzero(counts < words):
        one = np.uint64(counts[k])
        for x in h[firsts[k] : firsts[k] + counts[k]]:
            one = np.uint64((int(one) * int(STEP) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        keys.append(mix64(np.array([one], np.uint64)))
        owner.append(text[firsts[k] : firsts[k] + 1])
    key = np.sort((np.concatenate(owner).astype(np.uint64) << np.uint64(48)) | (np.concatenate(keys) & LOW))
    new = np.flatnonzero(np.diff(key, prepend=key[0] ^ np.uint64(1)))
    return (key[new] >> np.uint64(48)).astype(np.int64), key[new] & LOW, np.diff(np.append(new, len(key))).astype(float)


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash: n x registers shingle hashes; two texts agree in a register with their probability Jaccard.

    Each shingle is a Poisson process whose rate is its weight; an arrival falls on a random
    register, which keeps the shingle that arrives first.  A shingle stops as soon as its next
    arrival is later than the latest register of its text.
    """
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    time, state = np.zeros(len(text)), shingle * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    limit = np.full(n, np.inf)
    while len(text):
        state = mix64(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> np.uint64(20)) + np.uint64(1)) * (1.0 / (1 << 44))) / weight
        early = time < limit[text]
        text, shingle, weight, time, state = text[early], shingle[early], weight[early], time[early], state[early]
        at = text * registers + (((state & np.uint64(0xFFFFF)) * np.uint64(registers)) >> np.uint64(20)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        winner[at[won]] = shingle[won]
        if len(text):
            those = np.unique(text) if len(text) < n else np.arange(n)
            limit[those] = first.reshape(n, registers)[those].max(axis=1)
    return winner.reshape(n, registers)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key for each band of ``rows`` registers."""
    n, registers = signature.shape
    bands = signature.reshape(n, registers // rows, rows)
    key = np.broadcast_to(np.arange(1, registers // rows + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key * STEP + bands[:, :, k])
    return key.view(np.int64)


def probability_jaccard(a: np.ndarray, v: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets: the sum over common i of 1 / sum_j max(v_j / v_i, w_j / w_i)."""
    common, i, k = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    vi, wi = v[i], w[k]
    only_v, only_w = v.sum() - vi.sum(), w.sum() - wi.sum()
    ratio, where = np.unique(vi / wi, return_inverse=True)
    total = np.array([only_v + r * only_w + np.maximum(vi, r * wi).sum() for r in ratio])
    return float((vi / total[where]).sum())
