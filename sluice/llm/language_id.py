"""Language identification by mixture inference over byte trigrams.

Each language has a smoothed distribution over hashed byte trigrams of A-Z-lowered text between spaces. A document is a mixture: expectation
maximisation estimates its language proportions, for the sets of its most likely languages of growing size, up to all; the set with the best
likelihood less PENALTY * (size - 1) * ln(trigrams) is chosen. Sizes that a bound of the likelihood of any set rules out are not fitted. The prediction is the chosen set's largest share; equal ones go to the first language by name.

The model has languages x BINS numbers, whatever the corpus; counts are over all learning rows and are summed in the tasks before the shuffle.

Nulls and odd input: a null text or one without a letter is ``und`` with score 0; so is every text if nothing could be learned; rows with a null lang are
not learned from; repeated rows count and stay; a very long text is a chunk of its own; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import kernel as K

BINS = 1 << 15
ROUNDS = 10
PENALTY = 3.0
SMOOTH = 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all byte trigrams and the text of each."""
    n = len(data) - 2
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = K._LOWER[data].astype(np.uint32)
    x = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
    bins = ((x * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:-2] == owner[2:]
    return bins[inside], owner[:-2][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) batches to (lang, bin, n), summed over the task."""
    held: dict[str, np.ndarray] = {}

    def flush():
        names, bins, counts = [], [], []
        for name, row in held.items():
            at = np.flatnonzero(row)
            names += [name] * len(at)
            bins.append(at)
            counts.append(row[at])
        held.clear()
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cat(bins).astype(np.int32)), pa.array(cat(counts))], ["lang", "bin", "n"])

    for batch in batches:
        data, offsets = K.text_buffers(batch.column(0))
        names, of = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True) if batch.num_rows else ([], None)
        for a, b in K.chunks(offsets):
            bins, owner = trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            kind = of[a:b][owner]
            for k in np.unique(kind):
                row = held.setdefault(str(names[k]), np.zeros(BINS, np.int64))
                row += np.bincount(bins[kind == k], minlength=BINS)
        if len(held) > 500:
            yield flush()
    yield flush()


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name and their log-probabilities of bins, from all rows of docs (text, lang) with a lang."""
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), "lang")
    counted = rows.mapInArrow(_count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most languages x BINS rows
    names = sorted(counted["lang"].unique())
    table = np.zeros((len(names), BINS))
    table[counted["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(dtype=np.int64), counted["bin"].to_numpy(dtype=np.int64)] = counted["n"]
    return names, np.log((table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * BINS))


def infer(data: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages (a row for each text; 0 outside the chosen set) and the scores of the largest."""
    texts, languages = len(offsets) - 1, len(model)
    bins, owner = trigrams(data, offsets)
    keys, counts = np.unique(owner * BINS + bins, return_counts=True)
    owner, bins, counts = keys // BINS, keys % BINS, counts.astype(float)
    shares, score = np.zeros((texts, languages)), np.zeros(texts)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    if not len(first):
        return shares, score
    present, row = owner[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
    log_p = model.T[bins]
    total = np.add.reduceat(counts, first)
    alone = np.add.reduceat(log_p * counts[:, None], first)
    top = log_p.max(axis=1)
    p = np.exp(log_p - top[:, None])
    base = np.add.reduceat(top * counts, first)

    def mixture(start: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihoods by EM for the given documents, from the given shares (0 stays 0)."""
        chosen = np.zeros(len(first), bool)
        chosen[docs] = True
        at = np.flatnonzero(chosen[row])
        number = np.cumsum(chosen) - 1
        r, q, n = number[row[at]], p[at], counts[at]
        begin = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        pi = start
        for _ in range(ROUNDS):
            joint = q * pi[r]
            joint *= (n / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
            pi = np.add.reduceat(joint, begin) / total[docs][:, None]
        return pi, np.add.reduceat(n * np.log(np.maximum((q * pi[r]).sum(axis=1), 1e-300)), begin) + base[docs]

    best = alone.argmax(axis=1)
    chosen_shares = np.zeros((len(first), languages))
    chosen_shares[np.arange(len(first)), best] = 1
    relative = np.exp(np.clip(alone - alone.max(axis=1, keepdims=True), -700, 0))
    chosen_score = (relative / relative.sum(axis=1, keepdims=True))[np.arange(len(first)), best]
    if languages > 1:
        every, likely = mixture(np.full((len(first), languages), 1 / languages), np.arange(len(first)))
        # no shares have a likelihood above this: by Jensen's inequality, from the slopes at the shares found
        slope = np.add.reduceat(p * (counts / np.maximum((p * every[row]).sum(axis=1), 1e-300))[:, None], first) / total[:, None]
        most = likely + total * np.log(np.maximum(slope.max(axis=1), 1))
        order = np.argsort(-every, axis=1, kind="stable")
        value = alone.max(axis=1)
        for size in range(2, languages + 1):
            docs = np.flatnonzero(most - PENALTY * (size - 1) * np.log(np.maximum(total, 2)) > value)
            if not len(docs):
                break
            start = np.zeros((len(docs), languages))
            np.put_along_axis(start, order[docs, :size], np.take_along_axis(every[docs], order[docs, :size], 1) + 1e-3, 1)
            pi, likely = mixture(start / start.sum(axis=1, keepdims=True), docs)
            likely = likely - PENALTY * (size - 1) * np.log(np.maximum(total[docs], 2))
            better = likely > value[docs]
            value[docs[better]], chosen_shares[docs[better]] = likely[better], pi[better]
            chosen_score[docs[better]] = pi[better].max(axis=1)
    shares[present], score[present] = chosen_shares, chosen_score
    return shares, score


def predict(docs: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, shares): languages of the chosen set, the largest share first."""
    rows = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known"), F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("text"))
    small = model.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(3))
            known = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in K.chunks(offsets):
                n = b - a
                if len(names):
                    shares, score = infer(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], small)
                else:
                    shares, score = np.zeros((n, 1)), np.zeros(n)
                shares[~known[a:b]], score[~known[a:b]] = 0, 0
                best, sets, parts = [], [], []
                for row in shares:
                    at = [i for i in np.argsort(-row, kind="stable") if row[i] > 0]
                    sets.append([names[i] for i in at])
                    parts.append([float(row[i]) for i in at])
                    best.append(names[at[0]] if at else "und")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(best, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>")


def report(docs: DataFrame) -> DataFrame:
    """Learns from the rows of docs that are not held out and predicts all."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return predict(rows, *learn(rows.filter(~held_out(F.col("doc_id")))))
