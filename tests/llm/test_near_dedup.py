import random
import re

import numpy as np
import pyarrow as pa

from sluice.llm import kernel as K
from sluice.llm import near_dedup
from sluice.llm import sketch as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(docs, k):
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def cases(n=40):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdeé", k=3))
    docs = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([3, 5, 40, 90, 200]))]
        for _ in range(r.choice([1, 1, 2, 12])):
            copy = [word() if r.random() < r.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            docs.append(" ".join(copy) if r.random() < 0.7 else "\t".join(copy).upper())
    docs += ["", None, " \n ", "one", "ONE", "a b c", "a b c d", "  x", "same same same same same same", "same " * 50]
    r.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def test_matches_brute_force(spark):
    docs = cases()
    rows = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, member int")
    assert sorted(tuple(x) for x in near_dedup.near_duplicates(rows, 4).collect()) == brute(docs, 4)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(w if r.random() > 0.03 * (i % 3) else f"x{r.random()}" for w in base)) for i in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 5)
    assert sorted(tuple(x) for x in got.collect()) == brute(docs, 5)


def test_compare_links_outliers_of_a_pivot():
    r = np.random.default_rng(0)
    base = np.unique(r.integers(0, 1 << 40, 400).astype(np.uint64))
    far = np.sort(np.append(base[:300], np.arange(100, dtype=np.uint64)))
    sets = [base, far, np.sort(np.append(far[:-5], np.uint64(1 << 45))), base[:395]]
    links, alone = near_dedup._compare([9, 1, 2, 3], sets, 0, set(), 80)
    assert set(links) == {(3, 9), (1, 2)} and alone == [1, 2]


def test_rows_stay_whole(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "a"), (5, text, "a"), (2, text + " end", "b"), (None, text, "c"), (7, None, "d"), (8, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = {(x.doc_id, x.component_id, x.kept) for x in near_dedup.near_duplicates(df).collect()}
    assert got == {(5, 2, False), (2, 2, True), (None, 2, False), (7, 7, True), (8, 8, True)}
    assert sorted((str(x.doc_id), x.kept) for x in near_dedup.keep_one(df).collect()) == [("2", "b"), ("7", "d"), ("8", "e"), ("None", "c")]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_sketch_concentrates():
    texts = [" ".join(f"{i}" for i in range(a, a + 500)) for a in (0, 50, 250)] + ["x"]
    elements, of = S.shingle_sets(*K.text_buffers(pa.array(texts)), 1)
    sk = S.sketches(elements, of, 512)
    assert (sk != np.uint64((1 << 64) - 1)).all()
    for i, want in ((1, 450 / 550), (2, 250 / 750), (3, 0)):
        assert abs((sk[0] == sk[i]).mean() - want) < 0.08
