"""Removal of passages that an earlier document has, found by compressed FM-indexes of shards.

A window is ``window`` consecutive words. Windows are dealt to shards by content: the least hash of the runs of
``GRAM`` words in a window is its key, so equal windows have equal keys and consecutive ones mostly share theirs; a document falls
into segments of windows with one key.

1. A scan sends the distinct keys of each block (a scan partition) to the tasks that count them. Keys of one document only go no further.
2. Segments with shared keys go to their key's shard as word hashes. A block chunk sends equal segments once, with the least doc_id.
3. A shard indexes its distinct segments in an FM-index and streams all segments through it. Backward search over the wavelet matrix gives
   each window's interval in the index; its least doc_id decides whether a smaller document has the window too.
4. Covered windows return to their blocks, where the words that they cover are taken out.

Nothing is compared by pairs, so work grows with the text; a passage in many documents costs a shard one segment a chunk.

Nulls and odd input: a null text has no words; rows with a null doc_id are not ordered, so they lose nothing and remove nothing; rows that share
a doc_id do not remove each other's words; a document of fewer words than a window stays whole; a very long text is a slice of its own; an empty table gives no rows; extra columns are kept by ``remove_repeats``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import kernel as K
from sluice.llm.blocks import BLOCK_ROWS, block_rows, chunk_rows, first_row, opened, packed, rows_of, slices
from sluice.llm.fm_index import FMIndex
from sluice.llm.shared import source_bytes, tasks_for

GRAM = 5
#: Windows of a segment at most; only a key that repeats within itself would make longer ones.
SEGMENT = 32
#: Keys that a scan task gathers before it sends them on.
GATHER = 4 << 20
LOW = np.uint64((1 << 40) - 1)


def segments(words: K.Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, windows) of the segments of all texts."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = min(GRAM, window)
    values = np.full(len(hashes), np.uint64((1 << 64) - 1))
    found, at = K.grams(hashes, words.of, gram)
    values[at] = found
    width, span = 1, window - gram + 1
    least = values
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width :][:n])
    owner = words.owner
    valid = owner[:n] == owner[window - 1 :]
    at = np.flatnonzero(valid)
    key, owner = least[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    run = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    new |= run % SEGMENT == 0
    first = np.flatnonzero(new)
    return key[first], at[first], np.diff(np.append(first, len(at)))


def _hashed(rows: pa.RecordBatch, text: int) -> tuple[K.Words, np.ndarray]:
    """Words of a slice of rows and their hashes; few megabytes at a time."""
    data, offsets = K.text_buffers(rows.column(text))
    words = K.split(data, offsets)
    return words, K.hash_spans(data, words.starts, words.ends)


def _keys(window: int, parts: int):
    """(text, ordered, block) batches to the distinct keys of the task: (part, block, blob of 40-bit keys and whether two texts have them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, row, block = [], 0, 0, None

        def merged(key, low, high):
            order = np.argsort(key)
            key, low, high = key[order], low[order], high[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            return (key[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)) if len(first) else (key, low, high)

        def flush():
            key, low, high = merged(*(np.concatenate(x) for x in zip(*held)))
            part = (key >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            out = []
            for p in range(parts):
                if len(x := order[cuts[p] : cuts[p + 1]]):
                    out.append((p, packed((key[x] & LOW).view(np.uint8).reshape(-1, 8)[:, :5], np.packbits(low[x] != high[x]))))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([block] * len(out), pa.int32()), pa.array([b for _, b in out], pa.binary())], ["part", "block", "blob"])

        for _, _, rows in slices(batches, 0):
            block = rows.column(2)[0].as_py()
            words, hashes = _hashed(rows, 0)
            key, first, _ = segments(words, hashes, window)
            owner = np.searchsorted(words.of, first, "right") - 1
            known = rows.column(1).to_numpy(zero_copy_only=False)[owner] if len(owner) else np.zeros(0, bool)
            held.append(merged(key[known], row + owner[known], row + owner[known]))
            size += len(held[-1][0])
            row += rows.num_rows
            if size > GATHER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part to the keys, of each block, that two texts have somewhere."""
    part, held = None, []

    def close():
        if not held:
            return block_rows([], 0, [], [])
        every = np.concatenate([k for _, k, _ in held])
        flags = np.concatenate([m for _, _, m in held])
        keys, counts = np.unique(every, return_counts=True)
        common = np.union1d(keys[counts > 1], every[flags])
        out = [(b, k[np.isin(k, common, assume_unique=True)]) for b, k, _ in held]
        out = [(b, packed(k.view(np.uint8).reshape(-1, 8)[:, :5])) for b, k in out if len(k)]
        return block_rows([b for b, _ in out], 0, [part] * len(out), [x for _, x in out])

    for batch in batches:
        for p, b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if p != part:
                yield close()
                part, held = p, []
            keys, flags = opened(blob.as_py(), np.uint8, np.uint8)
            keys = _five(keys)
            held.append((b, keys, np.unpackbits(flags, count=len(keys)).astype(bool)))
    yield close()


def _dealt(window: int, parts: int, shards: int, ids: int, text: int):
    """Rows sorted by block, kind and seq to segments of shared keys: (shard, block, seq, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found, common = None, [], None
        for batch in batches:
            for b, kind, seq, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if b != block:
                    block, found, common = b, [], None
                if kind == 0:
                    found.append(_five(opened(blob.as_py(), np.uint8)[0]) | (np.uint64(seq) << np.uint64(40)))
                    continue
                if common is None:
                    common = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                if not len(common):
                    continue
                rows = rows_of(blob.as_py())
                words, hashes = _hashed(rows, text)
                key, first, count = segments(words, hashes, window)
                key = (key & LOW) | (((key >> np.uint64(40)) % np.uint64(parts)) << np.uint64(40))
                where = np.minimum(np.searchsorted(common, key), len(common) - 1)
                row = np.searchsorted(words.of, first, "right") - 1
                ordered = rows.column(ids).is_valid().to_numpy(zero_copy_only=False)
                kept = np.flatnonzero((common[where] == key) & (ordered[row] if len(row) else True))
                if not len(kept):
                    continue
                key, first, count, row = key[kept], first[kept], count[kept], row[kept]
                doc = rows.column(ids).fill_null(0).to_numpy()[row]
                length = count + window - 1
                # a hash for each segment's words: equal segments of one chunk are sent once
                sums = np.append(np.uint64(0), np.cumsum(hashes * K._power(K._ODD, len(hashes) + 1)[: len(hashes)], dtype=np.uint64))
                whole = K.mix((sums[first + length] - sums[first]) * K._power(K._INVERSE, len(hashes) + 1)[first] + length.astype(np.uint64))
                order = np.lexsort([doc, whole])
                leader = np.append(True, whole[order[1:]] != whole[order[:-1]])
                group = np.cumsum(leader) - 1
                shard = ((key >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
                lead = order[leader]
                out = []
                by = np.argsort(shard[lead], kind="stable")
                cuts = np.flatnonzero(np.append(True, shard[lead][by][1:] != shard[lead][by][:-1]))
                sizes = np.diff(np.append(np.flatnonzero(leader), len(order)))
                starts = np.flatnonzero(leader)
                for x in np.split(by, cuts[1:]):
                    members = order[K.spread(starts[x], sizes[x])]
                    chosen = lead[x]
                    raw = hashes[K.spread(first[chosen], length[chosen])]
                    out.append((int(shard[chosen[0]]), packed(length[chosen].astype(np.uint32), raw.view(np.uint8).reshape(-1, 8)[:, :5], sizes[x].astype(np.uint32), doc[members], (row[members] + first_row(rows)).astype(np.uint32), (first[members] - words.of[row[members]]).astype(np.uint32))))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([block] * len(out), pa.int32()), pa.array([seq] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], ["shard", "block", "seq", "blob"])

    return run


def _search(window: int):
    """Rows sorted by shard to covered windows: (block, 0, seq, blob of row, first word, windows)."""

    def close(held: list) -> pa.RecordBatch:
        if not held:
            return block_rows([], 0, [], [])
        lengths, raw, sizes, docs, rows, places = (np.concatenate(x) for x in zip(*(h[2] for h in held)))
        words, of = _five(raw), np.append(0, np.cumsum(lengths, dtype=np.int64))
        leader = np.append(0, np.cumsum(sizes, dtype=np.int64))[:-1]
        least = docs[leader]  # within a chunk the members of a segment are in order
        # equal segments of several chunks are indexed once, with their least document
        sums = np.append(np.uint64(0), np.cumsum(words * K._power(K._ODD, len(words) + 1)[: len(words)], dtype=np.uint64))
        whole = K.mix((sums[of[1:]] - sums[of[:-1]]) * K._power(K._INVERSE, len(words) + 1)[of[:-1]] + lengths.astype(np.uint64))
        order = np.lexsort([least, whole])
        new = np.append(True, whole[order[1:]] != whole[order[:-1]])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        chosen = order[new]
        text, ends = words[K.spread(of[chosen], lengths[chosen])], np.append(0, np.cumsum(lengths[chosen], dtype=np.int64))
        index = FMIndex(text, ends, least[chosen], window)
        smallest = index.least_values(text, ends)
        # every member of a segment has the segment's windows
        group = np.repeat(group, sizes)
        count = np.diff(ends)[group] - window + 1
        at = K.spread(ends[group], count)
        member = np.repeat(np.arange(len(group)), count)
        covered = np.flatnonzero(smallest[at] < docs[member])
        member, place = member[covered], at[covered] - ends[group[member[covered]]]
        chunk = np.repeat(np.arange(len(held)), [len(h[2][3]) for h in held])
        out, cuts = [], np.searchsorted(chunk[member], np.arange(len(held) + 1))
        for i, (block, seq, _) in enumerate(held):
            m, p = member[cuts[i] : cuts[i + 1]], place[cuts[i] : cuts[i + 1]]
            if len(m):
                begins = np.append(True, (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1))
                first = np.flatnonzero(begins)
                out.append((block, seq, packed(rows[m[first]], (places[m[first]] + p[first]).astype(np.uint32), np.diff(np.append(first, len(m))).astype(np.uint32))))
        return block_rows([b for b, _, _ in out], 0, [s for _, s, _ in out], [x for _, _, x in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            for s, block, seq, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if s != shard:
                    yield close(held)
                    shard, held = s, []
                held.append((block, seq, opened(blob.as_py(), np.uint32, np.uint8, np.uint32, np.int64, np.uint32, np.uint32)))
        yield close(held)

    return run


def kept_words(rows: pa.RecordBatch, text: int, covers: list[bytes], window: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The kept words of each row, joined by one space, and the numbers of words and of removed words."""
    data, offsets = K.text_buffers(rows.column(text))
    words = K.split(data, offsets)
    edge = np.zeros(len(words.starts) + 1, np.int64)
    for blob in covers:
        row, place, count = (x.astype(np.int64) for x in opened(blob, np.uint32, np.uint32, np.uint32))
        row -= first_row(rows)
        here = (row >= 0) & (row < rows.num_rows)  # other rows of the slice came in another piece
        row, place, count = row[here], place[here], count[here]
        np.add.at(edge, words.of[row] + place, 1)
        np.add.at(edge, words.of[row] + place + count + window - 1, -1)
    kept = np.cumsum(edge[:-1]) == 0
    at, n = np.flatnonzero(kept), words.counts
    left = np.diff(np.append(0, np.cumsum(kept))[words.of])
    size = words.ends[at] - words.starts[at] + 1
    out = K.gather_bytes(np.append(data, np.uint8(32)), words.starts[at], size)
    out[np.cumsum(size) - 1] = 32
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(left))]
    # the space after a text's last word goes
    last = ends[1:][left > 0] - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    offsets = (ends - np.append(0, np.cumsum(left > 0))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), rows.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(out[keep])]), n, n - left


def _finished(window: int, text: int, whole: bool):
    """Rows sorted by block, seq and kind to the input's rows with the kept text, n_words and n_removed. whole: texts that lose nothing stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, covers = None, []
        for batch in batches:
            for b, kind, seq, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if (b, seq) != at:
                    at, covers = (b, seq), []
                if kind == 0:
                    covers.append(blob.as_py())
                    continue
                rows = rows_of(blob.as_py())
                kept, n, removed = kept_words(rows, text, covers, window)
                if whole:
                    import pyarrow.compute as pc

                    kept = pc.if_else(pa.array(removed > 0), kept, rows.column(text))
                columns = list(rows.columns)
                columns[text] = kept
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64))], [*rows.schema.names, "n_words", "n_removed"])

    return run


def remove_repeats(docs: DataFrame, window: int = 13, whole: bool = True) -> DataFrame:
    """docs, all columns, with texts less their covered words, and n_words and n_removed at the end.

    A text that loses words becomes its kept words joined by one space; so does, without ``whole``, every other text.
    """
    names = docs.columns
    ids, text = names.index("doc_id"), names.index("text")
    size, tasks = source_bytes(docs), tasks_for(docs)
    parts, shards = max(64, math.ceil(size / (32 << 20))), max(64, math.ceil(size / (8 << 20)))
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))  # clashing names can't arise
    rows = rows.withColumn(f"c{ids}", F.col(f"c{ids}").cast("bigint")).withColumn(f"c{text}", F.col(f"c{text}").cast("string")).withColumn("block", F.spark_partition_id())
    keys = rows.select(f"c{text}", F.col(f"c{ids}").isNotNull(), "block").mapInArrow(_keys(window, parts), "part int, block int, blob binary")
    common = keys.repartitionById(tasks, F.col("part")).sortWithinPartitions("part").mapInArrow(_shared, BLOCK_ROWS)
    few = rows.select(f"c{ids}", f"c{text}", "block").mapInArrow(chunk_rows(1), BLOCK_ROWS)
    dealt = common.unionByName(few).repartitionById(tasks, F.col("block")).sortWithinPartitions("block", "kind", "seq").mapInArrow(_dealt(window, parts, shards, 0, 1), "shard int, block int, seq bigint, blob binary")
    covered = dealt.repartitionById(tasks, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_search(window), BLOCK_ROWS)
    every = rows.mapInArrow(chunk_rows(text), BLOCK_ROWS)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    done = covered.unionByName(every).repartitionById(tasks, F.col("block")).sortWithinPartitions("block", "seq", "kind").mapInArrow(_finished(window, text, whole), schema)
    return done.toDF(*names, "n_words", "n_removed")


def report(docs: DataFrame) -> DataFrame:
    """The digest form of ``remove_repeats``."""
    done = remove_repeats(docs.select("doc_id", "text"), whole=False)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
