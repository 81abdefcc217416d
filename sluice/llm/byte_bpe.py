"""Byte-level BPE over a global dictionary of distinct pre-tokens.

Encoding is a join of pre-token occurrences with a dictionary in which each distinct pre-token is encoded once. The
occurrences keep their place: what is shuffled is, for each block of documents (a scan partition), its distinct pre-tokens, then their
ids, and the block's texts, compressed. In a block the ids are joined to all occurrences and put together by position.

  texts -> (part, block, distinct pre-tokens)  -- shuffle by part -->  each encoded once
        -> (block, ids of its pre-tokens)      -- shuffle by block, with the block's texts -->  ids by position

Tasks hold the dictionary of one block or part and one chunk of texts. A pre-token that a block's dictionary lacks (the scan
was divided in another way between the branches) is encoded on the spot, so that results never depend on the division.
Decoding joins ids with the table of token bytes, whose size the vocabulary fixes.

Nulls and odd input: a null text is an empty one and has no ids; a null doc_id stays null; repeated rows stay; a very long text is a chunk of its own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import kernel as K
from sluice.llm.blocks import BLOCK_ROWS, CHUNK, chunk_rows, opened, packed, rows_of
from sluice.llm.shared import source_bytes, tasks_for

#: Distinct pre-tokens that a scan task gathers before it sends them on, in bytes.
GATHER = 64 << 20
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
_classes: list[np.ndarray] = []


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def character_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    if not _classes:
        import regex

        table = np.full(0x110000, OTHER, np.uint8)
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every = "".join(map(chr, points))
        points = np.array(points)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start() : m.end()]] = kind
        _classes.append(table)
    return _classes[0]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pattern's matches in each text, and their offsets by text.

    The pattern splits into runs of letters, of numbers or of other characters, each with one space before it; white
    space before a run keeps its last character apart; 's 't 're 've 'm 'll 'd are apart where a match begins.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.searchsorted(at, offsets)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), bounds
    kind, blank = character_classes()[points], points == 32
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True  # where a text begins, and the end
    run = opens[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[0] = True
    space, mark = kind == SPACE, np.zeros(n, bool)
    first = np.flatnonzero(run & ~space)
    joined = np.zeros(len(first), bool)
    inner = first > 0
    joined[inner] = blank[first[inner] - 1] & ~opens[first[inner]]
    mark[first - joined] = True
    closes = np.append(run[1:], True)
    last = np.flatnonzero(space & closes)
    followed = ~opens[last + 1]
    mark[last[followed & ~blank[last]]] = True
    mark[run & space] = True
    quote = np.flatnonzero((points == 39) & mark)
    text_end = bounds[np.searchsorted(bounds, quote, "right")] if len(quote) else quote
    for suffix in ("s", "t", "re", "ve", "m", "ll", "d"):
        fits = quote + len(suffix) < text_end
        for j, c in enumerate(suffix):
            fits &= points[np.minimum(quote + 1 + j, n - 1)] == ord(c)
        q = quote[fits]
        mark[q + 1] = False
        rest = q + 1 + len(suffix)
        rest = rest[rest < text_end[fits]]
        mark[rest[kind[rest] == LETTER]] = True
    chosen = np.flatnonzero(mark)
    starts = at[chosen]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(chosen, bounds)


def _words(parts: int):
    """(text, block) batches to the distinct pre-tokens of the task, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, held, size = None, np.zeros(0, np.uint64), [], 0

        def flush():
            hashes, lengths, raw = (np.concatenate(x) if held else np.zeros(0, np.int64) for x in (zip(*held) if held else ((), (), ())))
            begin, part = np.cumsum(lengths) - lengths, (hashes >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            blobs = [(p, packed(lengths[x].astype(np.uint32), K.gather_bytes(raw, begin[x], lengths[x]))) for p in range(parts) if len(x := order[cuts[p] : cuts[p + 1]])]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in blobs], pa.int32()), pa.array([block] * len(blobs), pa.int32()), pa.array([b for _, b in blobs], pa.binary())], ["part", "block", "blob"])

        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            block = batch.column(1)[0].as_py() if batch.num_rows else block
            for a, b in K.chunks(offsets, CHUNK):
                part = data[offsets[a] : offsets[b]]
                starts, ends, _ = pretokens(part, offsets[a : b + 1] - offsets[a])
                if len(starts):
                    hashes, index = np.unique(K.hash_spans(part, starts, ends), return_index=True)
                    if len(seen):
                        where = np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)
                        new = seen[where] != hashes
                        hashes, index = hashes[new], index[new]
                    lengths = ends[index] - starts[index]
                    held.append((hashes, lengths, K.gather_bytes(part, starts[index], lengths)))
                    seen = np.sort(np.append(seen, hashes))
                    size += int(lengths.sum())
                if size > GATHER:
                    yield flush()
                    seen, held, size = np.zeros(0, np.uint64), [], 0
        if held:
            yield flush()

    return run


def _encoder(ranks: dict[bytes, int]):
    """Bytes of one pre-token to ids: the whole is one piece for the merges."""
    import tiktoken

    core = tiktoken.Encoding("own", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
    return lambda word: core.encode_ordinary(word.decode("utf-8"))


def _encode_words(ranks_of):
    """(part, block, blob of words), sorted by part, to (block, 0, part, hashes, id counts and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, known = _encoder(ranks_of()), None, {}
        for batch in batches:
            blobs = []
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(2)):
                if p != part:
                    part, known = p, {}
                lengths, raw = opened(blob.as_py(), np.uint32, np.uint8)
                ends = np.cumsum(lengths, dtype=np.int64)
                text, ids, counts = raw.tobytes(), [], np.zeros(len(lengths), np.uint32)
                for i, (a, b) in enumerate(zip((ends - lengths).tolist(), ends.tolist())):
                    word = text[a:b]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = encode(word)
                    ids += found
                    counts[i] = len(found)
                blobs.append(packed(K.hash_spans(raw, ends - lengths, ends), counts, np.array(ids, np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.zeros(len(blobs), np.int32)), batch.column(0).cast(pa.int64()), pa.array(blobs, pa.binary())], ["block", "kind", "seq", "blob"])

    return run


class _Dictionary:
    """Pre-token hashes to runs of ids."""

    def __init__(self, blobs: list[bytes], encode):
        self.encode = encode
        found = [opened(b, np.uint64, np.uint32, np.uint32) for b in blobs] or [[np.zeros(0, t) for t in (np.uint64, np.uint32, np.uint32)]]
        hashes, counts, self.ids = (np.concatenate(x) for x in zip(*found))
        begin = np.cumsum(counts, dtype=np.int64) - counts
        self.hashes, index = np.unique(hashes, return_index=True)
        self.begin, self.counts = begin[index], counts[index].astype(np.int64)

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        where = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        lacking = np.flatnonzero(self.hashes[where] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if not len(lacking):
            return where
        new, index = np.unique(hashes[lacking], return_index=True)
        runs = [self.encode(data[starts[i] : ends[i]].tobytes()) for i in lacking[index]]
        counts = np.array([len(r) for r in runs], np.int64)
        begin = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.append(self.ids, np.array([x for r in runs for x in r], np.uint32))
        order = np.argsort(np.append(self.hashes, new))
        self.hashes, self.begin, self.counts = np.append(self.hashes, new)[order], np.append(self.begin, begin)[order], np.append(self.counts, counts)[order]
        return np.searchsorted(self.hashes, hashes)


def _assemble(ranks_of, decoded: bool):
    """Rows sorted by block, kind and seq to (doc_id, ids), and bytes if they are to be decoded at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, blobs, words = None, [], None
        ranks = ranks_of()
        encode, table = _encoder(ranks), _Bytes(ranks) if decoded else None
        for batch in batches:
            for b, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if b != block:
                    block, blobs, words = b, [], None
                if kind == 0:
                    blobs.append(blob.as_py())
                    continue
                if words is None:
                    words, blobs = _Dictionary(blobs, encode), []
                rows = rows_of(blob.as_py())
                data, offsets = K.text_buffers(rows.column(1))
                starts, ends, of = pretokens(data, offsets)
                ids, per_text = np.zeros(0, np.int32), np.zeros(rows.num_rows, np.int64)
                if len(starts):
                    where = words.find(K.hash_spans(data, starts, ends), data, starts, ends)
                    counts = words.counts[where]
                    ids = words.ids[K.spread(words.begin[where], counts)].astype(np.int32)
                    sums = np.append(0, np.cumsum(counts))
                    per_text = sums[of[1:]] - sums[of[:-1]]
                offsets = np.append(0, np.cumsum(per_text))
                columns = [rows.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
                names = ["doc_id", "ids"]
                if table is not None:
                    columns, names = [*columns, table.decode(ids, offsets)], [*names, "bytes"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, ranks_path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every text, by the ranks in the file; without special tokens. decoded: with ``bytes``, as ``decode`` adds them."""

    def ranks_of() -> dict[bytes, int]:
        return read_ranks(ranks_path)

    parts, tasks = max(64, math.ceil(source_bytes(docs) / (32 << 20))), tasks_for(docs)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("block"))
    words = rows.select("text", "block").mapInArrow(_words(parts), "part int, block int, blob binary")
    known = words.repartitionById(tasks, F.col("part")).sortWithinPartitions("part").mapInArrow(_encode_words(ranks_of), BLOCK_ROWS)
    texts = rows.mapInArrow(chunk_rows(1), BLOCK_ROWS)
    both = known.unionByName(texts).repartitionById(tasks, F.col("block")).sortWithinPartitions("block", "kind", "seq")
    return both.mapInArrow(_assemble(ranks_of, decoded), "doc_id bigint, ids array<int>" + ", bytes binary" * decoded)


class _Bytes:
    """The table of token bytes, to join ids with."""

    def __init__(self, ranks: dict[bytes, int]):
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.raw = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Bytes of the runs of ids."""
        size = self.lengths[ids]
        ends = np.append(0, np.cumsum(size))[offsets].astype(np.int32)
        data = K.gather_bytes(self.raw, self.begin[ids], size)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids) with the bytes of the ids, joined with the token table: column ``bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Bytes(read_ranks(ranks_path))
        for batch in batches:
            lists = batch.column(1)
            offsets, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            for a, b in K.chunks(offsets, CHUNK // 4):
                found = table.decode(ids[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists.slice(a, b - a), found], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, bytes binary")


def report(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Digests of the ids and of what they decode to."""
    both = encode(docs, ranks_path, decoded=True)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
