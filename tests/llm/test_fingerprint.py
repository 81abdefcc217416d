import hashlib
import math
import random
import re
from collections import Counter

from sluice.llm import fingerprint

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def weights(text):
    return {w: 1 + math.log(n) for w, n in Counter(WORD.findall(text)).items()}


def similar(a, b):
    a, b = weights(a), weights(b)
    if not a and not b:
        return 1.0
    every = a.keys() | b.keys()
    return sum(min(a.get(w, 0), b.get(w, 0)) for w in every) / sum(max(a.get(w, 0), b.get(w, 0)) for w in every)


def brute(docs):
    """(doc_id, n_chars, edited text, next text) in the order of doc_id."""
    rows = sorted((i, t or "") for i, t in docs)
    for at, (i, t) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        q = len(t) // 4
        yield i, len(t), t[: len(t) - q] + following[:q], t, following


def cases():
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefé日\U0001f600", k=r.randrange(1, 4)))
    return [(i * 7 % 101, r.choice([" ", "\n "]).join(word() for _ in range(r.choice([1, 2, 30, 200, 600])))) for i in range(60)] + [(500, None), (501, ""), (502, "x"), (503, " \t "), (504, "a b"), (-3, "a  b c")]


def test_edited_texts_and_likeness(spark):
    docs = cases()
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, n int").repartition(5)
    got = {x.doc_id: x for x in fingerprint.report(df).collect()}
    assert len(got) == len(docs)
    far = []
    for i, n, changed, own, following in brute(docs):
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (n, hashlib.sha256(changed.encode()).hexdigest())
        far += [abs(x.near_edited - similar(own, changed)), abs(x.near_next - similar(own, following))]
    assert sum(far) / len(far) < 0.06 and max(far) < 0.3
    assert got[500].fingerprint == got[501].fingerprint == got[503].fingerprint == "0" * 6 * fingerprint.SAMPLES


def test_equal_texts_have_equal_fingerprints_and_rows_stay(spark):
    rows = [(1, "one two three four"), (1, "one two three four"), (2, "one two three four"), (None, "five six seven eight"), (3, "nine")]
    got = fingerprint.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(x.doc_id) for x in got) == ["1", "1", "2", "3", "None"]
    assert len({x.fingerprint for x in got if x.doc_id in (1, 2)}) == 1
    changed = {x.doc_id: x.edited_sha256 for x in got}
    assert changed[None] == hashlib.sha256(b"five six seven ").hexdigest()
    assert changed[3] == hashlib.sha256(b"nino").hexdigest()
    assert all(x.near_next == 1.0 for x in got if x.doc_id == 1)


def test_samples_agree_as_often_as_the_generalised_jaccard_similarity(spark):
    a, b = "x " * 9 + "y z " + "q " * 3, "x " * 3 + "y w " + "q " * 5
    df = spark.createDataFrame([(0, 7, a, b)], "id long, n long, text string, changed string")
    x = fingerprint.sampled(df, ["id"], ["n"], 2000).first()
    assert x.n == 7 and len(x.own) == len(x.changed) == 2000
    assert abs(sum(p == q for p, q in zip(x.own, x.changed)) / 2000 - similar(a, b)) < 0.04


def test_a_fingerprint_is_of_the_text_alone(spark):
    docs = [(i, t) for i, t in cases() if i < 100]
    alone = {x.doc_id: x.samples for x in fingerprint.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    beside = {x.doc_id: x.fingerprint for x in fingerprint.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: "".join(f"{v:06x}" for v in s) for i, s in alone.items()} == beside


def test_many_rows_without_a_doc_id_and_a_very_long_text(spark):
    r = random.Random(3)
    long = " ".join(str(r.randrange(5000)) for _ in range(300_000))
    rows = [(None, f"w{i} x y z") for i in range(500)] + [(1, long), (2, long), (3, "w1 x y z")]
    got = fingerprint.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 503 and sum(x.doc_id is None and x.near_next == 0.0 for x in got) == 500
    by = {x.doc_id: x for x in got if x.doc_id}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0
    edited = {x.edited_sha256 for x in got if x.doc_id is None}
    assert edited == {hashlib.sha256(t[: len(t) - len(t) // 4].encode()).hexdigest() for i, t in rows if i is None}


def test_empty_table(spark):
    assert fingerprint.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_fingerprint_has_48_samples(spark):
    x = fingerprint.report(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert len(x.fingerprint) == len(x.edited_fingerprint) == 6 * 48
