"""Word-piece lengths of texts by a longest-match automaton, without building pieces.

Greedy longest-match-first splits a word into the longest piece of the vocabulary that begins it, and so on. The automaton is the
vocabulary's trie with two numbers for each node: a failure link, the node of what is left after the greedy pieces at its beginning are
popped, and how many these are. A word is read byte by byte; where no branch fits, the state follows its failure link and adds its count,
so that the work grows with the word's length only (Song et al., Fast WordPiece Tokenization).

Pieces that begin a word are marked in the vocabulary. All single bytes are pieces, so every word is counted. A task counts a word the first time it
meets it, all new words of a chunk at once, and looks it up after that.

Nulls and odd input: a null or word-less text has 0 words and 0 pieces; repeated rows stay; a very long text is a chunk of its own; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import kernel as K

#: The symbol before a word's bytes.
START = 256
#: Known words that a task keeps.
KNOWN = 2_000_000


def read_pieces(path: str) -> list[tuple[int, ...]]:
    """The pieces of a SentencePiece model as symbols: the mark of a word's beginning is START; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or not piece or "▁" in piece[1:]:
            continue
        begins = piece.startswith("▁")
        out.append((START,) * begins + tuple(piece[begins:].encode()))
    return out


class Automaton:
    """The trie of the pieces and of all single symbols, with failure links and popped counts."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in [*pieces, *((b,) for b in range(START + 1))]:
            at = 0
            for c in piece:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    whole.append(False)
                at = children[at][c]
            whole[at] = at > 0
        fail, popped = [0] * len(children), [0] * len(children)
        queue = [(0, c, v) for c, v in children[0].items()]
        for parent, c, node in queue:
            queue += [(node, d, v) for d, v in children[node].items()]
            if whole[node]:
                fail[node], popped[node] = 0, 1
                continue
            at, count = fail[parent], popped[parent]
            while c not in children[at]:  # ends at the root, where every symbol has a branch
                at, count = fail[at], count + popped[at]
            fail[node], popped[node] = children[at][c], count
        # a word's end: what is left is popped down to the root
        rest = [0] * len(children)
        for _, _, node in queue:  # by length, so the shorter failure node is done
            rest[node] = popped[node] + rest[fail[node]]
        pairs = sorted((node * (START + 1) + c, v) for node, branch in enumerate(children) for c, v in branch.items())
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*pairs))
        self.fail, self.popped, self.rest = np.array(fail), np.array(popped), np.array(rest)

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of pieces of each word, one symbol of all words after another."""
        n = len(starts)
        total, state = np.zeros(n, np.int64), np.full(n, self.to[np.searchsorted(self.keys, START)])
        order = np.argsort(-(ends - starts), kind="stable")
        at, stop = starts[order], ends[order]
        state, sums, live, step = state[order], total.copy(), n, 0
        longest = int((stop - at).max(initial=0))
        lengths = stop - at
        for step in range(longest):
            live = int(np.searchsorted(-lengths, -step, "left"))  # words longer than step
            c = data[at[:live] + step].astype(np.int64)
            todo = np.arange(live)
            while len(todo):
                key = state[todo] * (START + 1) + c[todo]
                where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                fits = self.keys[where] == key
                state[todo[fits]] = self.to[where[fits]]
                todo = todo[~fits]
                sums[todo] += self.popped[state[todo]]
                state[todo] = self.fail[state[todo]]
        total[order] = sums + self.rest[state]
        return total


def _counts(pieces: list[tuple[int, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(pieces)
        known, known_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for a, b in K.chunks(offsets):
                part = data[offsets[a] : offsets[b]]
                words = K.split(part, offsets[a : b + 1] - offsets[a])
                hashes, index, where = np.unique(K.hash_spans(part, words.starts, words.ends), return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                new = known[place] != hashes if len(known) else np.ones(len(hashes), bool)
                counts = np.zeros(len(hashes), np.int64)
                if len(known):
                    counts[~new] = known_counts[place[~new]]
                counts[new] = automaton.count(part, words.starts[index[new]], words.ends[index[new]])
                if len(known) > KNOWN:
                    known, known_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    new[:] = True
                if new.any():
                    known, known_counts = np.append(known, hashes[new]), np.append(known_counts, counts[new])
                    order = np.argsort(known)
                    known, known_counts = known[order], known_counts[order]
                sums = np.append(0, np.cumsum(counts[where])) if len(where) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts.astype(np.int64)), pa.array(np.diff(sums[words.of]))], ["doc_id", "n_words", "n_pieces"])

    return run


def count_pieces(docs: DataFrame, pieces: list[tuple[int, ...]]) -> DataFrame:
    """Per document: doc_id, n_words (runs of no white space) and n_pieces (their greedy word pieces)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counts(pieces), "doc_id bigint, n_words bigint, n_pieces bigint")
