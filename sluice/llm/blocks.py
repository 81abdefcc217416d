"""Blocks of rows that meet what other tasks found out about them.

A block is a partition of a scan. ``chunk_rows`` turns its rows into compressed chunks that carry all their columns, so that
a later shuffle by block brings them together with rows of findings about the block, at a fraction of the texts' size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from sluice.llm import kernel as K

CHUNK = 1 << 20
#: kind 0: findings; kind 1: a chunk of the block's rows.
BLOCK_ROWS = "block int, kind int, seq bigint, blob binary"


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.int64(a.nbytes).tobytes() + np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def opened(blob: bytes, *types) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(blob), [], 0
    for t in types:
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def block_rows(block: list[int], kind: int, seq: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([kind] * len(block), pa.int32()), pa.array(seq, pa.int64()), pa.array(blobs, pa.binary())], ["block", "kind", "seq", "blob"])


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(slice, first row within it, rows): the rows in slices of about CHUNK bytes in the column ``text``, one row at least.

    A slice ends where its own texts fill it, wherever batches end, so rows have equal numbers in all scans of the same rows, whatever other
    columns a scan has. A slice that lies in several batches comes in as many pieces; none is copied.
    """
    seq, row, size = 0, 0, 0
    for batch in batches:
        _, offsets = K.text_buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + CHUNK - size, "right")) - 1
            if row == 0:
                end = max(end, at + 1)
            end = min(end, batch.num_rows)
            if end > at:
                yield seq, row, batch.slice(at, end - at)
                row, size, at = row + end - at, size + int(offsets[end] - offsets[at]), end
            if at < batch.num_rows:
                seq, row, size = seq + 1, 0, 0


def chunk_rows(text: int):
    """Over batches whose last column is the block: its rows without this column, compressed; ``first_row`` tells where in their slice they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, first, part in slices(batches, text):
            rows = part.select(part.schema.names[:-1]) if len(set(part.schema.names)) == len(part.schema.names) else pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema.with_metadata({"first_row": str(first)})) as writer:
                writer.write_batch(rows)
            yield block_rows([part.column(part.num_columns - 1)[0].as_py()], 1, [seq], [zstandard.compress(sink.getvalue(), 1)])

    return run


def first_row(rows: pa.RecordBatch) -> int:
    """Where the first of the rows of a blob is in its slice."""
    return int(rows.schema.metadata[b"first_row"])


def rows_of(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(zstandard.decompress(blob))).read_next_batch()
