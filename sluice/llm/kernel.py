"""Array kernels over the bytes of many texts at once.

An Arrow string column is one byte buffer plus offsets, so splitting into words, folding case and hashing
every word are a few numpy passes over that buffer instead of a Python loop per word. All callers work on
chunks of about ``CHUNK`` bytes: a chunk always holds whole texts, so a text longer than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
KEPT = 5 << 20

_ODD = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, CHUNK + 1)  # tables for at most KEPT bytes are kept
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if size <= KEPT:
            _powers[base] = held
    return held


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def class_table(ranges: list[tuple[int, int]], lower: bool = False) -> np.ndarray:
    """True for bytes that separate words; with ``lower`` A-Z count as a-z."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out[_LOWER] if lower else out


#: Words are ``[^\x20\x09-\x0D]+``.
SPACES = class_table([(0x20, 0x20), (0x09, 0x0D)])
#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
NOT_WORD = class_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], lower=True)


@dataclass
class Words:
    """The words of several texts: ``starts``/``ends`` are byte positions, words of text i are ``of[i]:of[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), self.counts)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, of one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


def split(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACES) -> Words:
    """Words of each text: maximal runs of bytes that are no separators."""
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return Words(data, offsets, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, of the A-Z-lowered bytes on demand: a polynomial hash by prefix sums, then mixed."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    table = _SYMBOL[_LOWER] if lower else _SYMBOL
    np.cumsum(table[data] * _power(_ODD, n + 1)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def grams(hashes: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within one text, and the index of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0x2545F4914F6CDD1D)
        out += hashes[j : j + n]
    owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
    at = np.flatnonzero(owner[:n] == owner[k - 1 : k - 1 + n])
    return mix(out[at]), at


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + l)`` over all pairs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    s, l = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.cumsum(l)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + l[:-1] - 1)
    return np.cumsum(out)


def gather_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return data[spread(starts, lengths)]
