"""Shingle sets and their fast similarity sketches, for many texts at once.

The sketch has ``bins`` coordinates. In round i every element is hashed to one bin with the value i plus a fraction,
and a bin keeps its least value; round ``bins + b`` puts every element into bin b, so that every coordinate is filled
after 2 * bins rounds at most, in practice after about bins * ln(bins) / size rounds. Two coordinates agree with the
probability of the sets' Jaccard similarity, with Chernoff-like concentration over the coordinates.
"""

from __future__ import annotations

import numpy as np

from sluice.llm import kernel as K

#: Elements are 48-bit hashes, so that a chunk's (text, element) pairs sort as single 64-bit numbers.
BITS = 48
MOST_TEXTS = 1 << (64 - BITS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and their offsets by text. A text of fewer than k words has all its words as one shingle."""
    words = K.split(data, offsets)
    hashes = K.hash_spans(data, words.starts, words.ends, lower=True)
    shingles, at = K.grams(hashes, words.of, k)
    owner = words.owner[at] if len(at) else np.zeros(0, np.int64)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < k))
    for n in range(1, k):
        rows = short[counts[short] == n]
        if len(rows):
            first = words.of[rows]
            h = hashes[first].copy()
            for j in range(1, n):
                h = h * np.uint64(0x2545F4914F6CDD1D) + hashes[first + j]
            shingles, owner = np.append(shingles, K.mix(h + np.uint64(n))), np.append(owner, rows)
    keys = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | (shingles >> np.uint64(64 - BITS)))
    return keys & np.uint64((1 << BITS) - 1), np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BITS)) if len(offsets) <= MOST_TEXTS else None


def sketches(elements: np.ndarray, of: np.ndarray, bins: int) -> np.ndarray:
    """A row of ``bins`` values for each set; rows of empty sets hold the largest value only."""
    n = len(of) - 1
    empty = np.uint64((1 << 64) - 1)
    out = np.full((n, bins), empty, dtype=np.uint64)
    flat = out.reshape(-1)
    live, at_round = np.flatnonzero(np.diff(of) > 0), 0
    while len(live) and at_round < 2 * bins:
        size = of[live + 1] - of[live]
        x = K.mix(elements[K.spread(of[live], size)] + np.uint64(0x632BE59BD9B4E019 * (at_round + 1) & (1 << 64) - 1))
        row = np.repeat(live, size) * bins
        where = row + ((x % np.uint64(bins)).astype(np.int64) if at_round < bins else at_round - bins)
        np.minimum.at(flat, where, (np.uint64(at_round) << np.uint64(48)) | (x >> np.uint64(16)))
        live = live[(out[live] == empty).any(axis=1)]
        at_round += 1
    return out


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each run of ``rows`` coordinates; different bands never share hashes but by chance."""
    n, bins = values.shape
    out = np.zeros((n, bins // rows), dtype=np.uint64)
    for j in range(rows):
        out = K.mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, j::rows][:, : bins // rows])
    return K.mix(out + np.arange(bins // rows, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
