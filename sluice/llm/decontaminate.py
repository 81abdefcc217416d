"""Benchmark decontamination by suffix arrays of the training text.

Each shard (a chunk of whole documents) gets a suffix array over its words. Every suffix of every benchmark
item is looked up in it by binary search; the interval of suffixes that share its first words gives all
occurrences, and runs of occurrences along one diagonal give the longest verbatim matches. The array of a
shard is sparse: a document suffix enters it only if it begins with two words (one, for items of one word)
with which some benchmark suffix begins, since no other suffix can lie in a searched interval.

Nulls and odd input: a null text has no words and is never hit; an item without words is never found; repeated
items each count; a null item_id is listed as ``null``; extra columns are ignored (``remove_contaminated`` keeps them).
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import kernel as K

#: Benchmark text that one search block may hold; it is sent to every task. A larger benchmark is searched in several blocks, one after the other.
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, item_ids array<string>, longest_match bigint"


class Probe:
    """The suffixes of a block of benchmark items, packed for comparison by their first ``window`` words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        data, offsets = K.text_buffers(pa.array([t for _, t in items], pa.large_string()))
        words = K.split(data, offsets, K.NOT_WORD)
        hashes = K.hash_spans(data, words.starts, words.ends, lower=True)
        self.window, self.names = window, np.array([n for n, _ in items], dtype=object)
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        ids = ids.astype(np.int64) + 1  # 0: a word of no item, or past the end
        counts, owner = words.counts, words.owner
        place = np.arange(len(ids)) - words.of[owner]
        length = np.minimum(counts[owner], window)
        at = np.flatnonzero(place + length <= counts[owner])  # suffixes that begin with a whole window
        self.length, self.item, self.place = length[at], owner[at], place[at]
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.per_key = 63 // self.bits
        shown = np.zeros((len(at), window), dtype=np.int64)
        for j in range(window):
            inside = self.length > j
            shown[inside, j] = ids[at[inside] + j]
        low, high = self.pack(shown), self.pack(np.where(np.arange(window) < self.length[:, None], shown, (1 << self.bits) - 1))
        # equal windows are searched once
        bounds, self.which = np.unique(np.hstack([low, high]), axis=0, return_inverse=True)
        self.which = self.which.ravel()
        self.low, self.high = np.split(bounds, 2, axis=1) if len(bounds) else (low, high)
        self.single = np.unique(shown[self.length == 1, 0]) if len(at) else np.zeros(0, np.int64)
        pairs = shown[self.length > 1]
        self.starts = np.unique(pairs[:, 0] * (len(self.vocabulary) + 1) + pairs[:, 1]) if len(pairs) else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.order = np.argsort(self.which, kind="stable")
        self.of = np.searchsorted(self.which[self.order], np.arange(len(bounds) + 1))

    def pack(self, ids: np.ndarray) -> np.ndarray:
        keys = []
        for a in range(0, self.window, self.per_key):
            key = np.zeros(len(ids), dtype=np.int64)
            for j in range(a, min(self.window, a + self.per_key)):
                key = (key << self.bits) | ids[:, j]
            keys.append(key)
        return np.stack(keys, axis=1)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=np.int64)
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.vocabulary):
            found = np.searchsorted(self.vocabulary, hashes[maybe])
            found[found == len(self.vocabulary)] = 0
            good = self.vocabulary[found] == hashes[maybe]
            out[maybe[good]] = found[good] + 1
        return out

    def suffix_array(self, ids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of suffixes in the order of their first words, and these words packed. left: words to the text's end."""
        follows = np.append(ids[1:], 0)
        follows[left == 1] = 0
        kept = ids > 0
        if len(self.starts):
            pair = ids * (len(self.vocabulary) + 1) + follows
            found = np.searchsorted(self.starts, pair)
            found[found == len(self.starts)] = 0
            begins = self.starts[found] == pair
        else:
            begins = np.zeros(len(ids), dtype=bool)
        at = np.flatnonzero(kept & (begins | np.isin(ids, self.single)))
        shown = np.zeros((len(at), self.window), dtype=np.int64)
        for j in range(self.window):
            inside = left[at] > j
            shown[inside, j] = ids[at[inside] + j]
        keys = self.pack(shown)
        order = np.lexsort(keys.T[::-1])
        return at[order], keys[order]

    def occurrences(self, ids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (benchmark suffix, word position) pairs where the suffix's window occurs."""
        at, keys = self.suffix_array(ids, left)
        if not len(at) or not len(self.low):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = bisect(keys, self.low, False), bisect(keys, self.high, True)
        hit = np.flatnonzero(b > a)
        # each interval, once for each benchmark suffix that shows these words
        many = self.of[hit + 1] - self.of[hit]
        suffix = self.order[K.spread(self.of[hit], many)]
        width = np.repeat(b[hit] - a[hit], many)
        return np.repeat(suffix, width), at[K.spread(np.repeat(a[hit], many), width)]


def bisect(keys: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of rows in sorted rows, all at once."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        row = keys[np.minimum(middle, len(keys) - 1)]
        less, same = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
        for j in range(keys.shape[1]):
            less |= same & (row[:, j] < wanted[:, j])
            same &= row[:, j] == wanted[:, j]
        go = open_ & (less | same if right else less)
        low, high = np.where(go, middle + 1, low), np.where(open_ & ~go, middle, high)
    return low


def marks(texts: tuple[np.ndarray, np.ndarray], probe: Probe) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
    """For each text of a shard: words, items found, words of the longest verbatim match; and for each word of all texts whether it is hit (second)."""
    words = K.split(*texts, K.NOT_WORD)
    ids = probe.word_ids(K.hash_spans(words.data, words.starts, words.ends, lower=True))
    counts, owner, n = words.counts, words.owner, len(words.of) - 1
    suffix, at = probe.occurrences(ids, words.of[owner + 1] - np.arange(len(ids)))
    covered, longest, items = np.zeros(len(ids), bool), np.zeros(n, np.int64), [[] for _ in range(n)]
    if len(at):
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + probe.length[suffix], -1)
        covered = np.cumsum(edge[:-1]) > 0
        found = np.unique(np.stack([owner[at], probe.item[suffix]]), axis=1)
        for i, item in found.T:
            items[i].append(probe.names[item])
        item, place = probe.item[suffix], probe.place[suffix]
        order = np.lexsort([at, at - place, item])
        item, diagonal, pos = item[order], (at - place)[order], at[order]
        new = np.ones(len(pos), bool)
        new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1) | (owner[pos[1:]] != owner[pos[:-1]])
        begin = np.flatnonzero(new)
        run = np.diff(np.append(begin, len(pos))) - 1 + probe.length[suffix[order[begin]]]
        np.maximum.at(longest, owner[pos[begin]], run)
    return counts, covered, items, longest


def _hits(counts: np.ndarray, covered: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(counts)), counts), covered, len(counts)).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]]:
    """Runs of rows of about K.CHUNK bytes of text, and their texts."""
    for batch in batches:
        data, offsets = K.text_buffers(batch.column(text))
        for a, b in K.chunks(offsets):
            yield batch.slice(a, b - a), (data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _searched(batches: Iterator[pa.RecordBatch], blocks: list[list[tuple[str, str]]], window: int, text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[list[str]], np.ndarray]]:
    """Runs of rows with, for each row: words, words hit by any block, items found, words of the longest verbatim match.

    With several blocks the task's rows go to a temporary file of its own and are read once for each block, so that one probe is held at a time;
    of a run only the marks of its words, a bit each, and what its rows found stay from block to block.
    """
    if len(blocks) == 1:
        probe = Probe(blocks[0], window)
        for piece, texts in _pieces(batches, text):
            counts, covered, items, longest = marks(texts, probe)
            yield piece, counts, _hits(counts, covered), items, longest
        return
    with tempfile.TemporaryFile() as spool:
        writer = None
        for batch in batches:
            writer = writer or pa.ipc.new_stream(spool, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return
        writer.close()

        def spooled() -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]]:
            spool.seek(0)
            return _pieces(pa.ipc.open_stream(spool), text)

        found = []
        for n, block in enumerate(blocks):
            probe = Probe(block, window)
            for i, (_, texts) in enumerate(spooled()):
                counts, covered, items, longest = marks(texts, probe)
                if n == 0:
                    found.append((counts, np.packbits(covered), items, longest))
                    continue
                _, bits, before, most = found[i]
                bits |= np.packbits(covered)
                for x, y in zip(before, items):
                    x += y
                np.maximum(most, longest, out=most)
            del probe
        for (piece, _), (counts, bits, items, longest) in zip(spooled(), found):
            yield piece, counts, _hits(counts, np.unpackbits(bits, count=int(counts.sum())).astype(bool)), items, longest


def _search(blocks: list[list[tuple[str, str]]], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, counts, hits, items, longest in _searched(batches, blocks, window, 1):
            columns = [piece.column(0), pa.array(counts), pa.array(hits), pa.array(items, pa.list_(pa.string())), pa.array(longest)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "item_ids", "longest_match"])

    return run


def benchmark_blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of a checked size."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))).toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Per document: n_words, n_hit, item_ids (sorted), longest_match, contaminated (n_hit > 0 and share * n_hit >= n_words).

    The scan has no shuffle. A benchmark of more than BLOCK_BYTES is searched block by block within each task; a word is hit once, by however many blocks.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_search(list(benchmark_blocks(benchmark)), window), SCHEMA)
    hit = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return found.withColumn("item_ids", F.array_sort(F.array_distinct("item_ids"))).withColumn("contaminated", hit)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest form of ``contamination``."""
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "longest_match")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The rows of docs, all columns, without affected documents: those with a verbatim match of a whole window, however long they are, and those of
    which hits of shorter items cover a share-th part. The search and the decision run on each row by itself, in one scan."""
    blocks, at, schema = list(benchmark_blocks(benchmark)), docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, counts, hits, _, longest in _searched(batches, blocks, window, at):
            yield piece.filter(pa.array(~((longest >= window) | ((hits > 0) & (share * hits >= counts)))))

    return docs.mapInArrow(run, schema)


def sha256_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
