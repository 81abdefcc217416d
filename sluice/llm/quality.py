"""Quality by hierarchical empirical Bayes: a document's own evidence, and what its host and path are like.

Evidence is the log-odds of a logistic classifier over FEATURES of the text's form. A host's rate is the mean of its documents' classifier
probabilities, shrunk towards the global rate by as many pseudo-documents as the spread between hosts supports (method of moments);
a path's rate is shrunk towards its host's in the same way. The score is the evidence shifted by WEIGHT times the log-odds
of the path's rate against the global one: sites of few documents hardly move it.

Rates are grouped sums over all documents, pre-aggregated before their shuffle; the classifier is fitted on at most about SAMPLE labelled
documents. Both levels of rates come to a document by joins; a rate table of at most SMALL rows is sent to the tasks, after it was counted.

Nulls and odd input: a null host or path is a group of its own; a null or word-less text has score 0 and is rejected; without labels of both kinds
the evidence is 0 and all other texts are kept; repeated rows count and stay; a score equal to the threshold is kept; a very long text is a chunk of its own;
an empty table gives no rows; extra columns are ignored by ``assess`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import kernel as K
from sluice.llm import logistic
from sluice.llm.shared import cut

SAMPLE, WEIGHT, SMALL = 20_000, 0.5, 50_000
FEATURES = [
    "ln words", "mean word length", "distinct words", "words equal to the one before", "upper-case letters", "digits", "symbols",
    "words that end in a symbol", "words without letters", "repeated lines", "ln words a line", "longest word share", "distinct pairs of words",
]
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_SYMBOL = ~_LETTER & ~_DIGIT & ~K.SPACES
_PLAIN = _SYMBOL.copy()
_PLAIN[[ord(c) for c in ".,;:'\"()-"]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES for each text, and its number of words."""
    words = K.split(data, offsets)
    hashes = K.hash_spans(data, words.starts, words.ends, lower=True)
    n, count, owner = len(offsets) - 1, words.counts.astype(float), words.owner
    least, size = np.maximum(count, 1), np.maximum(np.diff(offsets), 1).astype(float)
    of_word = lambda x: np.bincount(owner, x, n)

    def of_byte(table: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(table[data]))
        return np.diff(sums[offsets])

    def distinct(h: np.ndarray, own: np.ndarray) -> np.ndarray:
        keys = np.unique(K.mix(h + own.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True)[1]
        return np.bincount(own[keys], minlength=n)

    length = (words.ends - words.starts).astype(float)
    again = np.zeros(len(hashes))
    if len(hashes) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    letters = np.append(0, np.cumsum(_LETTER[data]))
    blank = (letters[words.ends] - letters[words.starts]) == 0
    lines = K.split(data, offsets, K.class_table([(10, 10), (13, 13)]))
    line_hash, line_count = K.hash_spans(data, lines.starts, lines.ends), lines.counts.astype(float)
    pairs, at = K.grams(hashes, words.of, 2)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    columns = [
        np.log1p(count), of_word(length) / least, distinct(hashes, owner) / least, of_word(again) / least, of_byte(_UPPER) / size, of_byte(_DIGIT) / size, of_byte(_PLAIN) / size,
        of_word(_PLAIN[data[words.ends - 1]]) / least, of_word(blank) / least, 1 - distinct(line_hash, lines.owner) / np.maximum(line_count, 1), np.log1p(count / np.maximum(line_count, 1)), longest / size,
        (distinct(pairs, owner[at]) + 1) / np.maximum(count, 1),
    ]
    return np.stack(columns, axis=1), words.counts


def expand(x: np.ndarray) -> np.ndarray:
    """With squares and products, for a classifier that needs bends."""
    i, j = np.triu_indices(x.shape[1])
    z = np.clip(x, -20, 20)
    return np.hstack([z, z[:, i] * z[:, j]])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.text_buffers(batch.column(0))
        for a, b in K.chunks(offsets):
            x, _ = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(x.tolist(), pa.list_(pa.float64()))], ["quality", "features"])


def learn(docs: DataFrame, labels: DataFrame):
    """The classifier, from documents (doc_id, text) and labels (doc_id, quality 0 or 1); None without both kinds."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") != 0).cast("int").alias("quality"))
    n = known.count()
    if n > SAMPLE:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
    # about SAMPLE rows by now
    rows = docs.filter("text IS NOT NULL").join(F.broadcast(known), "doc_id").select("text", "quality")
    seen = rows.mapInArrow(_sampled, "quality int, features array<double>").limit(2 * SAMPLE).toPandas()
    y = seen["quality"].to_numpy(float)
    return logistic.fit(expand(np.array(seen["features"].tolist())), y, ridge=2.0) if 0 < y.sum() < len(y) else None


def _evidence(model, text: int):
    """Batches with their evidence and number of words as two more columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(text))
            for a, b in K.chunks(offsets):
                x, n = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found = logistic.logit(expand(x), model) if model is not None else np.zeros(b - a)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.clip(found, -30, 30)), pa.array(n.astype(np.int64))], [f"c{i}" for i in range(rows.num_columns + 2)])

    return run


def _strength(rows: DataFrame, n: str, rate: str, centre) -> float:
    """Pseudo-documents for groups (n, rate) around their centre, from the spread that sampling alone does not explain."""
    p = F.col(rate)
    s = rows.agg(F.sum(F.col(n) * (p - centre) ** 2).alias("spread"), F.sum(F.lit(1)).alias("groups"), F.sum(n).alias("n"), F.sum(F.col(n) * centre * (1 - centre)).alias("own")).first()
    if not s.n or not s.groups or s.n <= s.groups:
        return 1e6
    mean = s.own / s.n
    between = max((s.spread - s.groups * mean) / s.n, 1e-9)
    return float(min(max(mean / between - 1, 1.0), 1e6))


def rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_rate, path_rate) of rows (host, path, evidence), and the global rate."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = cut(scored.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("s")))
    every = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max((every.s or 0) / max(every.n or 0, 1), 1e-3), 1 - 1e-3)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")).withColumn("raw", F.col("host_s") / F.col("host_n"))
    k = _strength(hosts, "host_n", "raw", F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("host_s") + k * mean) / (F.col("host_n") + k)).alias("host_rate"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("raw", F.col("s") / F.col("n"))
    k = _strength(joined, "n", "raw", F.col("host_rate"))
    return joined.select("host", "path", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), mean


def _judged(rows: DataFrame, host: str, path: str, model, threshold: float, text_after: bool = True) -> DataFrame:
    """rows, all columns (the text only with text_after), with evidence, host_rate, path_rate, score and keep at the end.

    Evidence is taken once and kept with the rows in the shared folder, for the rates and then for the scores.
    """
    names = rows.columns
    numbered = rows.toDF(*(f"c{i}" for i in range(len(names))))
    text = names.index("text")
    numbered = numbered.withColumn(f"c{text}", F.col(f"c{text}").cast("string"))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in numbered.schema.fields), T.StructField(f"c{len(names)}", T.DoubleType()), T.StructField(f"c{len(names) + 1}", T.LongType())])
    h, p = F.col(f"c{names.index(host)}"), F.col(f"c{names.index(path)}")
    evidence, words = F.col(f"c{len(names)}"), F.col(f"c{len(names) + 1}")
    full = numbered.mapInArrow(_evidence(model, text), schema)
    left = [i for i in range(len(names)) if text_after or i != text]
    full = cut(full if text_after else full.drop(f"c{text}"))
    table, mean = rates(full.filter(words > 0).select(h.alias("host"), p.alias("path"), evidence.alias("evidence")))
    table = cut(table.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "host_rate", "path_rate"))
    if table.count() <= SMALL:
        table = F.broadcast(table)
    joined = full.join(table, h.eqNullSafe(F.col("_h")) & p.eqNullSafe(F.col("_p")), "left")
    logit = lambda x: F.log(x / (1 - x))
    site = F.coalesce(logit(F.least(F.greatest("path_rate", F.lit(1e-3)), F.lit(1 - 1e-3))), logit(F.lit(mean))) - logit(F.lit(mean))
    score = F.when(words > 0, 1 / (1 + F.exp(-(evidence + WEIGHT * site)))).otherwise(0.0)
    out = joined.select(*(F.col(f"c{i}") for i in left), evidence.alias("e"), "host_rate", "path_rate", score.alias("score"), ((words > 0) & (score >= threshold)).alias("keep"))
    return out.toDF(*(names[i] for i in left), "evidence", "host_rate", "path_rate", "score", "keep")


def assess(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, evidence, host_rate, path_rate, score (0 to 1) and keep (score >= threshold). host and path name columns."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    judged = _judged(rows, "host", "path", learn(rows, labels), threshold, text_after=False)
    return judged.select("doc_id", "evidence", "host_rate", "path_rate", "score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that are kept."""
    model = learn(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    names = docs.columns
    judged = _judged(docs, host, path, model, threshold)
    return judged.toDF(*(f"c{i}" for i in range(len(names) + 4)), "keep").filter("keep").select(*(f"c{i}" for i in range(len(names)))).toDF(*names)
