"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

1. One scan gives each document its shingle-set size, a 128-bit hash of the set, and band hashes of its sketch.
   Documents with equal sets form a class; only the class's least id goes on, so large groups of copies shrink to one row.
2. Classes that share a band hash meet in a bucket. A bucket's pivot is its member with the most company over all its
   buckets, near the middle of a group of edited copies; each member is paired with its buckets' pivots, never with every other member.
3. A pivot's members, in blocks of about BLOCK rows, fewer where sets are large, are compared on full sets: with the pivot, and with each other where
   they are not linked yet and an upper bound of their intersection (what both share with the pivot, plus the rest) reaches
   the threshold. Two documents of one bucket are both members of its pivot, so all pairs of all buckets are decided, while only
   links that join components leave the task. Members of a pivot with several blocks that are not linked to it visit its other blocks.
4. Components of the links, by the distributed contraction of ``components``; classes then hand their component to all their documents.

A pair at the threshold misses all bands with probability (1 - 0.8 ** ROWS) ** BANDS, below 1e-7.

Nulls and odd input: a null or word-less text has an empty set, is linked with nothing and is kept; a text of fewer than k words is
one shingle; rows that share a doc_id are one document (``keep_one`` leaves its row of the least hash of its columns of plain types); a row with a null doc_id takes part
in no link, and takes the component of its class if there is one; a very long text is one set of one task; shingles are told apart by 48 bits; empty tables
give no rows; extra columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import kernel as K
from sluice.llm import sketch as S
from sluice.llm.components import components
from sluice.llm.shared import cut

BANDS, ROWS = 32, 4
#: Members of one pivot that are compared at once, and how many shingles each counts for at least: a block holds BLOCK * WEIGHT shingles or so, or one larger set.
BLOCK, WEIGHT = 512, 4096
#: Places that the rows of one band or pivot are dealt to.
SALTS = 1024
#: Bits of the filter that keeps texts which are not wanted out of the second scan: SPARSE for a wanted document, within these bounds. Where there are not
#: even eight, wanted documents are met by a join.
SPARSE, LEAST_SLOTS, MOST_SLOTS = 64, 1 << 22, 1 << 27


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_id, bytes, offsets) of chunks of (doc_id, text) batches."""
    for batch in batches:
        data, offsets = K.text_buffers(batch.column(1))
        for a, b in K.chunks(offsets):
            for c in range(a, b, S.MOST_TEXTS - 1):
                d = min(b, c + S.MOST_TEXTS - 1)
                yield batch.column(0).slice(c, d - c), data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _slices(batches):
            elements, of = S.shingle_sets(data, offsets, k)
            size = np.diff(of)
            hashes = []
            for seed in (0x8CB92BA72F3D8DD7, 0x1B873593CC9E2D51):
                sums = np.append(np.uint64(0), np.cumsum(K.mix(elements + np.uint64(seed)), dtype=np.uint64))
                hashes.append(pa.array(K.mix(sums[of[1:]] - sums[of[:-1]] + size.astype(np.uint64)).view(np.int64)))
            band = S.bands(S.sketches(elements, of, BANDS * ROWS), ROWS).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(band.reshape(-1)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int64)), *hashes, lists], ["doc_id", "n_shingles", "h1", "h2", "bands"])

    return run


def _sets(k: int, wanted: np.ndarray):
    """(doc_id, text, slot) batches to the sets of documents whose slot is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def picked():
            for batch in batches:
                slot = batch.column(2).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array((wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))

        for ids, data, offsets in _slices(picked()):
            elements, of = S.shingle_sets(data, offsets, k)
            raw = elements.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array([raw[6 * a : 6 * b] for a, b in zip(of[:-1], of[1:])], pa.binary())], ["member", "elements"])

    return run


def _slot(doc_id, slots: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(slots))


def _bitmap(ids: DataFrame, slots: int) -> np.ndarray:
    """The slots of the ids, as bits: a filter that may pass more, never less."""
    slot = _slot("doc_id", slots) + 1
    found = ids.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(slots // 8, np.uint8)
    for bucket, bits in found.collect():  # slots / 32768 rows of 4 kB at most
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def _wanted_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(member, elements): the sets of the wanted documents (doc_id), and of a few others."""
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    n = wanted.count()
    if n * 8 > MOST_SLOTS:
        slots, seen = 8, np.full(1, 255, np.uint8)  # the join passes the wanted ones only
        text = text.join(wanted, "doc_id", "left_semi")
    else:
        slots = min(max(1 << (SPARSE * n).bit_length(), LEAST_SLOTS), MOST_SLOTS)
        seen = _bitmap(wanted, slots)
    return text.withColumn("slot", _slot("doc_id", slots)).mapInArrow(_sets(k, seen), "member bigint, elements binary").dropDuplicates(["member"])


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(ids: list[int], sets: list[np.ndarray], pivot: int, visitors: set[int], percent: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that join what is not joined yet, and the members not joined with the pivot. With visitors, only these are compared with the rest."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i in range(len(ids)):
        if i != pivot and _linked(sets[i], sets[pivot], percent):
            root[find(i)] = find(pivot)
            links.append((ids[i], ids[pivot]))
    group = np.array([find(i) for i in range(len(ids))])
    if len(set(group.tolist())) > 1 and len(ids) > 2:
        base, size = sets[pivot], np.array([len(s) for s in sets])
        shared = np.zeros((len(ids), len(ids)), np.float32)
        inside = np.zeros(len(ids), np.int64)
        for c in range(0, len(base), 4096):
            part = base[c : c + 4096]
            seen = np.stack([np.isin(part, s, assume_unique=True) for s in sets]).astype(np.float32)
            shared += seen @ seen.T
            inside += seen.sum(axis=1).astype(np.int64)
        extra = size - inside
        most = shared.astype(np.int64) + np.minimum(extra[:, None], extra[None, :])
        able = (most * (100 + percent) >= percent * (size[:, None] + size[None, :])) & (group[:, None] != group[None, :])
        if visitors:
            is_visitor = np.array([i in visitors for i in range(len(ids))])
            able &= is_visitor[:, None] & ~is_visitor[None, :]
        else:
            able = np.triu(able, 1)
        for i, j in zip(*(x.tolist() for x in np.nonzero(able))):
            if find(i) != find(j) and _linked(sets[i], sets[j], percent):
                root[find(i)] = find(j)
                links.append((ids[i], ids[j]))
    return links, [ids[i] for i in range(len(ids)) if find(i) != find(pivot)]


def _blocks(percent: int):
    """Over rows (pivot, block, blocks, member, visitor, elements) sorted by pivot and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, rows = None, []

        def close():
            if len(rows) > 1:
                ids = [r[1] for r in rows]
                pivot = ids.index(key[0])
                links, alone = _compare(ids, [_unpacked(r[3]) for r in rows], pivot, {i for i, r in enumerate(rows) if r[2]}, percent)
                out.extend((key[0], key[1], rows[0][0], a, b) for a, b in links)
                if rows[0][0] > 1 and not any(r[2] for r in rows):
                    out.extend((key[0], key[1], rows[0][0], a, None) for a in alone)

        def flush():
            columns = list(zip(*out)) if out else [[]] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["pivot", "block", "blocks", "a", "b"])
            out.clear()
            return batch

        for batch in batches:
            d = batch.to_pydict()
            for pivot, block, blocks, member, visitor, elements in zip(d["pivot"], d["block"], d["blocks"], d["member"], d["visitor"], d["elements"]):
                if (pivot, block) != key:
                    close()
                    key, rows = (pivot, block), []
                rows.append((blocks, member, visitor, elements))
            yield flush()
        close()
        yield flush()

    return run


def _with_total(rows: DataFrame, key: str, part: Column, whole: Column) -> DataFrame:
    """rows (key, member, ..) with ``total``: ``whole`` over the values ``part`` of the key's salts.

    Rows meet their total by key and salt of the member, so a key with a third of all rows takes SALTS places, and at most SALTS rows of a key meet in one.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(part.alias("total"))
    wholes = parts.groupBy(key).agg(whole.alias("total"))
    return salted.join(parts.select(key, "salt").join(wholes, key), [key, "salt"]).drop("salt")


def links(docs: DataFrame, signatures: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between class representatives, enough to connect all that are linked."""
    reps = signatures.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("member"), F.greatest(F.max("n_shingles"), F.lit(WEIGHT)).alias("weight"))
    entries = reps.select("member", "weight", F.explode("bands").alias("band"))
    met = cut(_with_total(entries, "band", F.count(F.lit(1)), F.sum("total")).filter("total > 1"))
    company = met.groupBy("member").agg(F.sum("total").alias("company"))
    known = met.select("band", "member", "weight").join(company, "member")
    pivots = _with_total(known, "band", F.max(F.struct("company", (-F.col("member")).alias("member"))), F.max("total"))
    pairs = cut(pivots.select((-F.col("total.member")).alias("pivot"), "member", "weight").distinct().filter("pivot <> member"))
    of = lambda n: F.ceil(n / (BLOCK * WEIGHT)).cast("int")
    blocks = pairs.groupBy("pivot").agg(of(F.sum("weight")).alias("blocks"))
    placed = _with_total(pairs, "pivot", F.sum("weight"), of(F.sum("total"))).withColumnRenamed("total", "blocks")
    placed = placed.select("pivot", F.pmod(F.xxhash64("member"), "blocks").cast("int").alias("block"), "blocks", "member")
    every = blocks.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", F.col("pivot").alias("member"))
    rows = placed.unionByName(every).withColumn("visitor", F.lit(False))
    wanted = rows.select(F.col("member").alias("doc_id")).distinct()
    sets = cut(_wanted_sets(docs, wanted, k))

    def compared(rows: DataFrame) -> DataFrame:
        full = rows.join(sets, "member").select("pivot", "block", "blocks", "member", "visitor", "elements")
        return cut(full.repartition("pivot", "block").sortWithinPartitions("pivot", "block").mapInArrow(_blocks(percent), "pivot bigint, block int, blocks int, a bigint, b bigint"))

    found = compared(rows)
    out = found.filter("b IS NOT NULL").select("a", "b")
    alone = found.filter("b IS NULL").select("pivot", F.col("block").alias("home"), "blocks", F.col("a").alias("member"))
    if not alone.isEmpty():
        to = alone.select("pivot", "home", "member", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).filter("block <> home")
        visits = to.select("pivot", "block", "blocks", "member", F.lit(True).alias("visitor"))
        hosts = rows.join(visits.select("pivot", "block").distinct(), ["pivot", "block"], "left_semi")
        out = out.unionByName(compared(visits.unionByName(hosts.select(visits.columns))).filter("b IS NOT NULL").select("a", "b"))
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id that it reaches by links), kept (it is that document).

    Links: 100 * intersection >= percent * union of the sets of k-word shingles of the A-Z-lowered texts.
    """
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signatures = cut(text.mapInArrow(_signatures(k), "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>"))
    member = components(links(docs, signatures, k, percent))
    same = signatures.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    classes = same.join(member, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    rows = signatures.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("h1")).alias("h1"), F.when(F.col("n_shingles") > 0, F.col("h2")).alias("h2"))
    found = rows.join(classes, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with one document of each component. Rows without a doc_id stay."""
    gone = near_duplicates(docs, k, percent).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    hashed = [f.name for f in docs.schema if f.dataType.typeName() in ("string", "long", "integer", "double", "boolean")]
    order, number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*hashed))), max(docs.columns, key=len) + "_"
    named = left.filter("doc_id IS NOT NULL").withColumn(number, order).filter(F.col(number) == 1).drop(number)
    return named.unionByName(left.filter("doc_id IS NULL"))
