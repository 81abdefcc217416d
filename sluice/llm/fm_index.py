"""A compressed FM-index over word sequences: a Burrows-Wheeler transform in a wavelet matrix of packed bits.

Suffixes are sorted by their first ``depth`` words, which is all that patterns of up to ``depth`` words need. Searches
run for many streamed sequences at once, one backward step of all of them after another.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank of a symbol in a prefix, over n symbols in about 1.5 bits a symbol and level."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.n, self.levels = len(symbols), max(1, int(size - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        s = symbols
        for level in reversed(range(self.levels)):
            bit = (s >> level) & 1
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            raw = np.append(raw, np.zeros(8 - len(raw) % 8, np.uint8)).view(np.uint64)
            self.words.append(raw)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(raw), dtype=np.int64)).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.base = self._down(np.arange(size), np.zeros(size, np.int64)) if size else np.zeros(0, np.int64)

    def _down(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            block = p >> 6
            ones = self.before[k][block] + np.bitwise_count(self.words[k][block] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)))
            p = np.where((c >> level) & 1, self.zeros[k] + ones, p - ones)
        return p

    def rank(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often the symbols c occur before the positions p."""
        return self._down(c, p) - self.base[c]


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of composite keys, equal for equal ones."""
    key = keys[0].astype(np.int64)
    for k in keys[1:]:
        key = key * (int(k.max(initial=0)) + 1) + k
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


class FMIndex:
    """Over sequences of word hashes (``words``, sequence i at ``of[i]:of[i + 1]``), each with a value; finds patterns of up to ``depth`` words."""

    def __init__(self, words: np.ndarray, of: np.ndarray, values: np.ndarray, depth: int):
        self.depth = depth
        self.alphabet, ids = np.unique(words, return_inverse=True)
        count = len(of) - 1
        # symbol 0 ends every sequence
        text = np.zeros(len(words) + count, np.int64)
        owner = np.repeat(np.arange(count), np.diff(of))
        text[np.arange(len(words)) + owner] = ids + 1
        n = len(text)
        ranks, done = {1: text}, 1
        shift = lambda r, k: np.append(r[k:], np.zeros(min(k, n), np.int64))[:n]
        while done * 2 <= depth - 1:
            ranks[done * 2] = _dense(ranks[done], shift(ranks[done], done))
            done *= 2
        short, have = ranks[done], done  # extend to depth - 1, then to depth
        for k in sorted(ranks, reverse=True):
            while have + k <= depth - 1:
                short = _dense(short, shift(ranks[k], have))
                have += k
        full = _dense(short, shift(text, have)) if depth > 1 else text
        order = np.argsort(full, kind="stable")
        self.first = np.searchsorted(text[order], np.arange(len(self.alphabet) + 2))
        self.bwt = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        short, full = short[order], full[order]

        def groups(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = np.append(True, r[1:] != r[:-1]) if n else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            return begin, np.cumsum(new) - 1

        self.short_begin, self.short_group = groups(short)
        self.full_begin, self.full_group = groups(full)
        sequence = np.repeat(np.arange(count), np.diff(of) + 1)
        self.least = np.minimum.reduceat(values[sequence[order]], self.full_begin) if n else values

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first depth - 1 words of the patterns of depth words whose intervals begin at low."""
        g = self.short_group[low]
        return self.short_begin[g], np.append(self.short_begin, self.bwt.n)[g + 1]

    def least_values(self, words: np.ndarray, of: np.ndarray) -> np.ndarray:
        """For each run of depth words of the streamed sequences the least value of the indexed sequences in which it occurs, or the largest number.

        Matching statistics with threshold ``depth``: each sequence is read backwards; an interval grows by a backward step for each word
        until it stands for depth words, and from there loses its last word before each further step. Where a word
        doesn't fit, the search begins anew one word before the run's end. The result has a row for each word, of the run that begins there.
        """
        none = np.iinfo(np.int64).max
        out = np.full(len(words), none, np.int64)
        where = np.minimum(np.searchsorted(self.alphabet, words), max(len(self.alphabet) - 1, 0))
        ids = np.where(self.alphabet[where] == words, where + 1, 0) if len(self.alphabet) else np.zeros(len(words), np.int64)
        lengths = np.diff(of)
        live = np.flatnonzero(lengths >= self.depth)
        live = live[np.argsort(-lengths[live], kind="stable")]
        at = of[live + 1] - 1
        stop = of[live]
        low, high, have = np.zeros(len(live), np.int64), np.full(len(live), self.bwt.n, np.int64), np.zeros(len(live), np.int64)
        while len(live):
            full = have == self.depth
            if full.any():
                low[full], high[full] = self.shorten(low[full])
                have[full] -= 1
            c = ids[at]
            new_low, new_high = self.first[c], self.first[c + 1]
            grown = have > 0
            if grown.any():
                p = self.bwt.rank(np.concatenate([c[grown], c[grown]]), np.concatenate([low[grown], high[grown]]))
                k = len(p) // 2
                new_low, new_high = new_low.copy(), new_high.copy()
                new_low[grown], new_high[grown] = self.first[c[grown]] + p[:k], self.first[c[grown]] + p[k:]
            fits = (new_high > new_low) & (c > 0)
            # no run of depth words that ends here has this word: runs that end one word before come next
            back = np.where(fits | (have == 0), -1, have - 1)
            low, high, have = np.where(fits, new_low, 0), np.where(fits, new_high, self.bwt.n), np.where(fits, have + 1, 0)
            reached = np.flatnonzero(have == self.depth)
            out[at[reached]] = self.least[self.full_group[low[reached]]]
            at = at + back
            go = at >= stop
            if not go.all():
                live, at, stop, low, high, have = live[go], at[go], stop[go], low[go], high[go], have[go]
        return out
