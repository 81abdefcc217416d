"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are A-Z-lowered words of letters and digits (and of all characters beyond ASCII), and the first four characters of longer ones. A token's score is the log-odds of its use in toxic against other documents, counted once a document, with
an informative Dirichlet prior from all learning text (PRIOR pseudo-tokens for each token there); tokens whose log-odds exceed Z standard errors enter the table, all
others cost a small constant. The segments of a document are all maximal-scoring runs of words, found in one linear pass (Ruzzo and
Tompa); only scoring words and the gaps between them are looked at. By Karlin and Altschul a segment of score S in m words has the value
L * S - ln(K * m), where L solves the score equation of clean text; segments of a value above LEAST are significant. A
logistic curve over the best and the summed values, fitted on at most SAMPLE labelled documents, gives the score.

Counts are over all labelled learning rows. The table holds every token that passes, which takes three toxic documents at least: it grows with the
vocabulary of the toxic labelled rows, not with the corpus, and goes to every task.

Nulls and odd input: a null or empty text has no segment and gets the base score; rows without a label or with a null one are not learned
from; several labels of a document all count; without labels of both kinds every score is 0; repeated rows
stay; equal scores are in the same place of the order; a very long text is a chunk of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import kernel as K
from sluice.llm import logistic
from sluice.llm.language_id import held_out
from sluice.llm.shared import source_bytes

PRIOR, Z, SAMPLE, LEAST = 0.05, 3.0, 20_000, 2.0
#: Labels in files of up to so many bytes are sent to the scan's tasks; beyond, both sides are shuffled.
SMALL = 4 << 20
K_FACTOR = 0.1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """The words, their hashes, and the hashes of their first four characters (0 for shorter words)."""
    words = K.split(data, offsets, K.NOT_WORD)
    hashes = K.hash_spans(data, words.starts, words.ends, lower=True)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    fifth = np.append(lead, [len(data)] * 5)[np.searchsorted(lead, words.starts) + 4]
    long = fifth < words.ends
    stems = np.zeros(len(hashes), np.uint64)
    stems[long] = K.hash_spans(data, words.starts[long], fifth[long], lower=True) ^ np.uint64(0x5555555555555555)
    return words, hashes, stems


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) batches to (token, n1, n0), summed over a few megabytes."""
    for batch in batches:
        data, offsets = K.text_buffers(batch.column(0))
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in K.chunks(offsets, 4 * K.CHUNK):
            words, hashes, stems = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            kind = toxic[a:b][words.owner]
            every, kind = np.append(hashes, stems[stems > 0]), np.append(kind, kind[stems > 0])
            owner = np.append(words.owner, words.owner[stems > 0]).astype(np.uint64)
            _, once = np.unique(K.mix(every + owner * np.uint64(0xD1342543DE82EF95)), return_index=True)
            every, kind = every[once], kind[once]
            found, where = np.unique(every, return_inverse=True)
            n1 = np.bincount(where, kind, len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n1), pa.array(np.bincount(where, minlength=len(found)) - n1)], ["token", "n1", "n0"])


class Model:
    def __init__(self, table: np.ndarray, scores: np.ndarray, other: float, rate: float, curve=None):
        order = np.argsort(table)
        self.table, self.scores, self.other, self.rate, self.curve = table[order], scores[order], other, rate, curve

    def word_scores(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.table):
            return np.full(len(hashes), self.other)
        where = np.minimum(np.searchsorted(self.table, hashes), len(self.table) - 1)
        return np.where(self.table[where] == hashes, self.scores[where], self.other)

    def passages(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, float]]]:
        """Per text the significant segments: first word, end word, value."""
        words, hashes, stems = tokens(data, offsets)
        score = self.word_scores(hashes)
        long = np.flatnonzero(stems)
        score[long] = np.maximum(score[long], self.word_scores(stems[long]))
        at = np.flatnonzero(score > 0)
        cuts, out = np.searchsorted(at, words.of), []
        for i in range(len(offsets) - 1):
            mine = at[cuts[i] : cuts[i + 1]] - words.of[i]
            found = segments(mine.tolist(), score[at[cuts[i] : cuts[i + 1]]].tolist(), self.other) if len(mine) else []
            base = np.log(K_FACTOR * max(1, words.of[i + 1] - words.of[i]))
            out.append([(a, b, v) for a, b, s in found if (v := float(self.rate * s - base)) > LEAST])
        return out


def segments(at: list[int], scores: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring runs (first, end, score) of a sequence whose places ``at`` score and whose others cost ``-other``, in linear time."""
    held: list[list] = []  # first, end, sum before, sum after
    total, last = 0.0, -1
    for place, s in zip(at, scores):
        total += other * (place - last - 1)
        run = [place, place + 1, total, total + s]
        total += s
        last = place
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= run[2]:
                j -= 1
            if j < 0 or held[j][3] >= run[3]:
                held.append(run)
                break
            run = [held[j][0], run[1], held[j][2], run[3]]
            del held[j:]
    return [(a, b, d - c) for a, b, c, d in held]


def summary(found: list[tuple[int, int, float]]) -> list[float]:
    values = [v for _, _, v in found]
    return [max(values, default=0.0), float(np.log1p(sum(values))), float(np.log1p(len(values)))]


def _features(model: Model):
    """(text, toxic) batches to (toxic, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            for a, b in K.chunks(offsets):
                found = model.passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array([summary(f) for f in found], pa.list_(pa.float64()))], ["toxic", "features"])

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """From documents (doc_id, text) and labels (doc_id, toxic 0 or 1)."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic"))
    if 0 < source_bytes(labels) <= SMALL:
        known = F.broadcast(known)
    rows = docs.filter("text IS NOT NULL").join(known, "doc_id").select("doc_id", "text", "toxic")
    counted = rows.select("text", "toxic").mapInArrow(_count, "token bigint, n1 bigint, n0 bigint").groupBy("token").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # both totals come with each row, from one pass over the counted tokens
    sums = counted.agg(F.sum("n1").alias("all1"), F.sum("n0").alias("all0")).first()
    all1, all0 = sums.all1 or 0, sums.all0 or 0
    if not all1 or not all0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0)
    prior = (F.col("n1") + F.col("n0")) * PRIOR
    odds = lambda n, total: F.log((F.col(n) + prior) / (total + PRIOR * (all1 + all0) - F.col(n) - prior))
    scored = counted.filter("n1 > 2").withColumn("score", odds("n1", all1) - odds("n0", all0)).withColumn("z", F.col("score") / F.sqrt(1 / (F.col("n1") + prior) + 1 / (F.col("n0") + prior)))
    best = scored.filter((F.col("z") > Z) & (F.col("score") > 0.7)).orderBy(F.desc("z"), "token").toPandas()
    score = best["score"].to_numpy(float)
    rare = (best["n0"].to_numpy(float) + 0.01) / (all0 + 1)
    other = float(np.clip(np.log((all1 - best["n1"].sum() + 1) / all1) - np.log((all0 - best["n0"].sum() + 1) / all0), -2.0, -0.2)) if len(best) else -1.0
    low, high = 0.0, 20.0  # the root of the score equation of clean text
    for _ in range(80):
        rate = (low + high) / 2
        total = float(np.sum(rare * np.exp(np.minimum(rate * score, 600)))) + max(0.0, 1 - rare.sum()) * np.exp(rate * other)
        low, high = (rate, high) if total < 1 else (low, rate)
    model = Model(best["token"].to_numpy(np.int64).view(np.uint64), score, other, min(max(low, 0.05), 4.0))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < _share(known))
    seen = sample.select("text", "toxic").mapInArrow(_features(model), "toxic int, features array<double>").limit(2 * SAMPLE).toPandas()
    y = seen["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        model.curve = logistic.fit(np.array(seen["features"].tolist()), y)
    return model


def _share(labels: DataFrame) -> int:
    """The threshold of a hash of 30 bits under which about SAMPLE labelled rows fall."""
    n = labels.count()
    return 1 << 30 if n <= SAMPLE else int((1 << 30) * (SAMPLE / n))


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, passages): passages are (first word, end word, value) of the significant segments."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("value", pa.float64())]))
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            for a, b in K.chunks(offsets):
                found = model.passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                score = np.zeros(b - a)
                if model.curve is not None:
                    score = 1 / (1 + np.exp(-np.clip(logistic.logit(np.array([summary(f) for f in found]), model.curve), -30, 30)))
                spans = [[{"first": x, "end": y, "value": v} for x, y, v in f] for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), pa.array(spans, kind)], ["doc_id", "held_out", "score", "passages"])

    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, passages array<struct<first:int,end:int,value:double>>")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labelled rows that are not held out and scores all documents."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learn(rows, labels.filter(~held_out(F.col("doc_id").cast("bigint"))))
    return assess(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages")
