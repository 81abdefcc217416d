"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is a set of words with weights 1 + ln(occurrences). For each of SAMPLES samples a word draws r and c from Gamma(2, 1) and b
from the unit interval, all functions of the word and the sample; with t = floor(ln(weight) / r + b) the sample is the (word, t) with the least
c * exp(-r * (t - b + 1)). Two documents have equal samples with the probability of their generalised Jaccard similarity,
sum of the least weights over sum of the largest. The gamma variates come from a table of TABLE quantiles.

A row's two texts are sampled together: what a word draws is drawn once for both. Words are counted within the row by an aggregate that spills,
the minima of WIDE samples are columns of another, and both find the rows dealt by doc_id, so no word leaves its task. A fingerprint is SAMPLES
numbers of 24 bits in hexadecimal digits.

Nulls and odd input: a null text is an empty one; texts without words have the fingerprint of zeros and are alike; rows that share a doc_id stay
rows of their own, and the next larger doc_id follows all of them (its least text, where it has several); a row with a null doc_id is followed by
nothing, loses its last quarter, and follows none; an empty table gives no rows; a very long text is one row of its task, as it is in the table;
extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm.shared import cut, source_bytes

SAMPLES = 48
TABLE = 4096
#: Samples that are columns of one aggregate.
WIDE = 4
SPACE = r"[\x20\x09-\x0D]+"
#: The kind of rows that stand for words.
WORD = 0


def gamma_quantiles(n: int) -> list[float]:
    """Of Gamma(2, 1), whose distribution function is 1 - (1 + x) * exp(-x), in the middle of n equal steps."""
    out, x = [], 0.0
    for i in range(n):
        p = (i + 0.5) / n
        low, high = x, 60.0
        for _ in range(80):
            x = (low + high) / 2
            low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < p else (low, x)
        out.append(x)
    return out


def _table(spark: SparkSession, values: list[float]) -> Column:
    """The numbers as one literal of the plan."""
    gateway = spark.sparkContext._gateway
    array = gateway.new_array(gateway.jvm.double, len(values))
    for i, v in enumerate(values):
        array[i] = v
    return F.lit(0.0).__class__(gateway.jvm.org.apache.spark.sql.functions.lit(array))


def _counted(rows: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """(key, kind, word, n0, n1): how often the words (kind WORD) are in ``text`` and in ``changed``; the i-th number kept is the "word" of kind WORD + 1 + i."""
    none = F.lit(None)
    texts = [F.struct(F.lit(side).alias("side"), F.lit(WORD).alias("kind"), F.col(c).alias("text"), none.cast("bigint").alias("number")) for side, c in enumerate(("text", "changed"))]
    numbers = [F.struct(F.lit(2).alias("side"), F.lit(WORD + 1 + i).alias("kind"), none.cast("string").alias("text"), F.col(c).cast("bigint").alias("number")) for i, c in enumerate(keep)]
    parts = rows.select(*key, F.explode(F.array(*texts, *numbers)).alias("x")).select(*key, "x.*")
    words = parts.select(*key, "side", "kind", "number", F.explode_outer(F.split("text", SPACE, -1)).alias("w")).filter(F.col("w").isNull() | (F.col("w") != ""))
    words = words.select(*key, "side", "kind", F.when(F.col("kind") > WORD, F.col("number")).otherwise(F.xxhash64("w")).alias("word"))
    return words.groupBy(*key, "kind", "word").agg(F.count(F.when(F.col("side") == 0, 1)).alias("n0"), F.count(F.when(F.col("side") == 1, 1)).alias("n1"))


def _drawn(words: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind, word, at) with what the WIDE samples from ``at`` on draw: h0, r0, c0, b0, t0 and u0 (t for the two texts), h1, .."""
    quantiles, ks = gamma_quantiles(TABLE), range(WIDE)
    r_table, c_table = _table(words.sparkSession, quantiles), _table(words.sparkSession, [math.log(x) for x in quantiles])
    weight = [f"CASE WHEN n{i} = 1 THEN 0D WHEN n{i} > 1 THEN ln(1D + ln(CAST(n{i} AS DOUBLE))) END AS weight{i}" for i in (0, 1)]
    rest = [*key, "kind", "word", "at", "weight0", "weight1"]
    hashed = words.selectExpr(*rest[:-2], *weight, *(f"xxhash64(word, at + {k}) AS h{k}" for k in ks))
    r = [F.get(r_table, F.expr(f"CAST(h{k} & {TABLE - 1} AS INT)")).alias(f"r{k}") for k in ks]
    c = [F.get(c_table, F.expr(f"CAST(shiftrightunsigned(h{k}, 12) & {TABLE - 1} AS INT)")).alias(f"c{k}") for k in ks]
    b = [F.expr(f"(shiftrightunsigned(h{k}, 24) & {(1 << 24) - 1}) / {float(1 << 24)}D AS b{k}") for k in ks]
    looked = hashed.select(*rest, *(f"h{k}" for k in ks), *r, *c, *b)
    return looked.selectExpr(*rest[:-2], *(x for k in ks for x in (f"h{k}", f"r{k}", f"c{k}", f"b{k}", f"floor(weight0 / r{k} + b{k}) AS t{k}", f"floor(weight1 / r{k} + b{k}) AS u{k}")))


def _least(k: int, t: str) -> str:
    """The least value of the k-th sample drawn, above 24 bits of its (word, t)."""
    value = f"shiftleft(CAST((c{k} - r{k} * ({t}{k} - b{k} + 1D) + 64D) * {float(1 << 32)}D AS BIGINT), 24)"
    return f"min(IF(kind = {WORD}, {value} | ((shiftrightunsigned(h{k}, 40) ^ shiftleft({t}{k}, 9) ^ {t}{k}) & {(1 << 24) - 1}), NULL))"


def sampled(rows: DataFrame, key: list[str], keep: list[str], samples: int = SAMPLES) -> DataFrame:
    """(key, keep, own, changed): the samples of the rows' ``text`` and ``changed`` as arrays; 0 stands for those of a text without words.

    key tells the rows apart, keep are whole numbers, one at least; samples is a multiple of WIDE. The rows of a key stay in their task if the
    rows are dealt by one of its columns.
    """
    every = F.lit(list(range(0, samples, WIDE)))
    counted = _counted(rows, key, keep)
    # the first number makes sure of a row for every block of samples
    each = counted.select("*", F.explode(F.when(F.col("kind") <= WORD + 1, every).otherwise(F.array(F.lit(0)))).alias("at"))
    least = [F.expr(f"{_least(k, t)} AS {t}{k}") for t in ("t", "u") for k in range(WIDE)]
    numbers = [F.expr(f"min(IF(kind = {WORD + 1 + i}, word, NULL))").alias(c) for i, c in enumerate(keep)]
    best = _drawn(each, key).groupBy(*key, "at").agg(*least, *numbers)
    low = lambda t: F.expr("array(" + ", ".join(f"CAST(coalesce({t}{k} & {(1 << 24) - 1}, 0) AS INT)" for k in range(WIDE)) + ")")
    blocks = best.select(*key, *keep, F.struct("at", low("t").alias("t"), low("u").alias("u")).alias("block"))
    whole = blocks.groupBy(*key).agg(*(F.max(c).alias(c) for c in keep), F.sort_array(F.collect_list("block")).alias("blocks"))
    return whole.select(*key, *keep, F.flatten("blocks.t").alias("own"), F.flatten("blocks.u").alias("changed"))


def as_text(samples: Column) -> Column:
    return F.lower(F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x), 6, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples: an estimate of the generalised Jaccard similarity."""
    equal = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(equal) / F.size(a)


#: Rows without a doc_id are dealt by as many keys from here on; they join nothing.
NONE, SALTS = -(1 << 63), 1 << 16


def followers(ids: DataFrame, files: int = 1) -> DataFrame:
    """(key, next_id, n) of ids (key, n_chars): the next larger id of each, the first after the last; n is the longest text of the id."""
    longest = ids.groupBy("key").agg(F.max("n_chars").alias("n"))
    # kept in few files: the ranges that the sampling of the ids gave must be the same for both uses below
    dealt = cut(longest.repartitionByRange("key").withColumn("range", F.spark_partition_id()).coalesce(files))
    first = dealt.groupBy("range").agg(F.min("key").alias("first"))
    # a row for each range: as many as there are partitions
    after = first.select("range", F.coalesce(F.lead("first").over(Window.orderBy("range")), F.min("first").over(Window.partitionBy())).alias("after"))
    inside = dealt.withColumn("next_id", F.lead("key").over(Window.partitionBy("range").orderBy("key")))
    return inside.join(F.broadcast(after), "range").select("key", F.coalesce("next_id", "after").alias("next_id"), "n")


def edited(docs: DataFrame) -> DataFrame:
    """(key, real, text, n_chars, next_id, changed): the last quarter of each text, rounded down, replaced by the next document's first characters.

    key is the doc_id; of a row without one (real is false) it is one of SALTS numbers, so that such rows are spread.
    """
    # no part of this is null to the optimiser: a filter of nulls before one join would give each join an exchange of its own
    doc_id, salted = F.col("doc_id").cast("bigint"), F.lit(NONE).cast("bigint").bitwiseOR(F.monotonically_increasing_id().bitwiseAND(SALTS - 1))
    rows = docs.select(F.coalesce(doc_id, salted).alias("key"), doc_id.isNotNull().alias("real"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select(doc_id.alias("key"), F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_chars")).filter("key IS NOT NULL")
    follow = followers(ids, max(1, source_bytes(docs) >> 28))
    quarter = lambda n: F.floor(n / 4).cast("int")
    asked = follow.select(F.col("next_id").alias("key"), F.col("key").alias("for_key"), quarter(F.col("n")).alias("first"))
    heads = rows.hint("merge").join(asked, "key").select(F.col("for_key").alias("to_key"), "real", F.struct(F.substring("text", F.lit(1), F.col("first")).alias("head"), F.col("key").alias("next_id")).alias("h"))
    # a condition here, for as a filter it would move below the exchange of the rows, which then no longer is that of the other join
    heads = heads.groupBy("to_key").agg(F.min(F.when(F.col("real"), F.col("h"))).alias("h")).select("to_key", "h.*")
    joined = rows.hint("merge").join(heads, F.col("key") == F.col("to_key"), "left").withColumn("n", F.char_length("text"))  # leaves the rows dealt by key
    head = F.when(F.col("real"), F.col("head"))
    cut_text = F.concat(F.substring("text", F.lit(1), F.col("n") - quarter(F.col("n"))), F.substring(F.coalesce(head, F.lit("")), F.lit(1), quarter(F.col("n"))))
    return joined.select("key", "real", "text", F.col("n").cast("bigint").alias("n_chars"), F.when(F.col("real"), F.col("next_id")).alias("next_id"), cut_text.alias("changed"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, samples) of documents (doc_id, text), a row for each."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return sampled(rows.withColumn("changed", F.col("text")), ["row"], ["doc_id"]).select("doc_id", F.col("own").alias("samples"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: n_chars, digest of its edited text, both fingerprints, and the likeness to the edited text and to the next document."""
    hexed = F.sha2(F.col("changed").cast("binary"), 256)
    sha = [F.conv(F.substring(hexed, 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"sha{i}") for i in range(4)]
    rows = edited(docs).select("key", F.monotonically_increasing_id().alias("row"), "real", "n_chars", "next_id", *sha, "text", "changed")
    found = cut(sampled(rows, ["key", "row"], ["real", "n_chars", "next_id", "sha0", "sha1", "sha2", "sha3"]).drop("row"))
    after = found.filter("real = 1").groupBy("key").agg(F.min("own").alias("after")).select(F.col("key").alias("to_key"), "after")
    joined = found.join(after, F.coalesce("next_id", "key") == F.col("to_key"), "left").withColumn("after", F.when(F.col("real") == 1, F.col("after")))
    digest = F.lower(F.concat(*(F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4))))
    return joined.select(
        F.when(F.col("real") == 1, F.col("key")).alias("doc_id"), "n_chars", digest.alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), F.coalesce(likeness(F.col("own"), F.col("after")), F.lit(0.0)).alias("near_next"),
    )
