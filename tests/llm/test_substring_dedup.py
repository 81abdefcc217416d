import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa

from sluice.llm import blocks, substring_dedup
from sluice.llm.fm_index import FMIndex, WaveletMatrix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, w=13):
    first, out = {}, []
    for i, text in docs:
        x = WORD.findall(text or "")
        if i is not None:
            for j in range(len(x) - w + 1):
                k = tuple(x[j : j + w])
                first[k] = min(i, first.get(k, i))
    for i, text in docs:
        x = WORD.findall(text or "")
        gone = set()
        if i is not None:
            for j in range(len(x) - w + 1):
                if first[tuple(x[j : j + w])] < i:
                    gone.update(range(j, j + w))
        kept = " ".join(v for j, v in enumerate(x) if j not in gone)
        out.append((i, len(x), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghé", k=r.randrange(1, 6)))
    passages = [[word() for _ in range(r.choice([12, 13, 14, 20, 60, 150]))] for _ in range(12)]
    docs = []
    for i in range(120):
        x = []
        for _ in range(r.randrange(5)):
            x += [word() for _ in range(r.randrange(30))]
            p = r.choice(passages)
            a = r.randrange(len(p))
            x += p if r.random() < 0.5 else p[a : a + r.randrange(1, 60)]
        docs.append((r.randrange(10**12), r.choice([" ", "\n", " \t "]).join(x) + r.choice(["", " "])))
    docs += [(docs[0][0], docs[0][1]), (5, docs[1][1]), (6, docs[1][1]), (7, None), (8, ""), (9, "same " * 400), (10, "same " * 100 + "other"), (None, docs[2][1]), (None, docs[2][1]), (-4, docs[3][1])]
    return docs


def test_matches_brute_force(spark):
    docs = cases()
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, block string")
    want = brute(docs)
    assert sum(x[2] for x in want) > 1000
    assert sorted((tuple(x) for x in substring_dedup.report(df.repartition(5)).collect()), key=str) == want
    assert sorted((tuple(x) for x in substring_dedup.report(df.coalesce(1)).collect()), key=str) == want


def test_other_columns_stay(spark):
    line = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([("a", 1, line + "  end", 0.5), ("b", 2, "x " + line + " y", None), ("c", 3, " z  z ", 1.0), ("d", 4, None, 1.0)], "n_words string, doc_id long, text string, score double")
    got = {x[1]: (x[0], x[2], x[3], x[4], x[5]) for x in substring_dedup.remove_repeats(df).collect()}
    assert got == {1: ("a", line + "  end", 0.5, 21, 0), 2: ("b", "x y", None, 22, 20), 3: ("c", " z  z ", 1.0, 2, 0), 4: ("d", None, 1.0, 0, 0)}
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_wavelet_ranks():
    r = np.random.default_rng(1)
    for size, n in ((1, 5), (2, 200), (700, 3000)):
        s = r.integers(0, size, n)
        w = WaveletMatrix(s, size)
        c, p = r.integers(0, size, 300), r.integers(0, n + 1, 300)
        assert w.rank(c, p).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, p)]


def test_index_finds_patterns_of_other_sequences():
    r = np.random.default_rng(2)
    held = [r.integers(0, 4, n) for n in (5, 30, 0, 80, 1)]
    asked = [r.integers(0, 6, n) for n in (40, 3, 60)] + held
    pack = lambda x: (np.concatenate(x).astype(np.uint64), np.append(0, np.cumsum([len(y) for y in x])))
    for depth in (1, 2, 3, 5, 13):
        index = FMIndex(*pack(held), np.array([9, 4, 7, 5, 3]), depth)
        words, of = pack(asked)
        got = index.least_values(words, of)
        for i, s in enumerate(asked):
            for j in range(len(s) - depth + 1):
                at = [v for v, t in zip((9, 4, 7, 5, 3), held) if any((t[k : k + depth] == s[j : j + depth]).all() for k in range(len(t) - depth + 1))]
                assert got[of[i] + j] == min(at, default=np.iinfo(np.int64).max), (depth, i, j)


def test_limits_of_batches_change_nothing(spark):
    docs = cases()
    docs += [(2 * 10**12 + i, t) for i, t in enumerate(t for _, t in docs)]
    df = spark.createDataFrame([(a, b, "wide " * (n % 7 * 300)) for n, (a, b) in enumerate(docs)], "doc_id long, text string, wide string").coalesce(1)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "20000")
    try:
        got = [(x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.text.encode()).hexdigest()) for x in substring_dedup.remove_repeats(df.na.fill({"text": ""}), whole=False).collect()]
    finally:
        spark.conf.set(limit, before)
    assert sorted(got, key=str) == brute(docs)


def test_slices_end_at_the_same_rows_in_all_batches(monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 40)
    r = random.Random(4)
    texts = ["x" * r.choice([0, 0, 1, 10, 39, 40, 41, 100]) for _ in range(300)]
    rows = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])

    def numbered(lengths):
        out, at = [], 0
        while at < len(texts):
            n = next(lengths)
            out.append(rows.slice(at, n))
            at += n
        return [(seq, first + i) for seq, first, part in blocks.slices(iter(out), 0) for i in range(part.num_rows)]

    want = numbered(iter([300]))
    assert len({seq for seq, _ in want}) > 50
    for n in (1, 2, 7, 50):
        assert numbered(itertools.repeat(n)) == want
