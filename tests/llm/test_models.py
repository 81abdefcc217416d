import random

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import kernel as K
from sluice.llm import language_id, quality, token_count, toxicity


def greedy(pieces, word):
    every, x, n = {tuple(p) for p in pieces} | {(b,) for b in range(257)}, (256, *word.encode()), 0
    while x:
        k = max(k for k in range(1, len(x) + 1) if x[:k] in every)
        x, n = x[k:], n + 1
    return n


def test_piece_counts_match_brute_force(spark):
    r = random.Random(3)
    for size in (0, 3, 40):
        pieces = [((256,) if r.random() < 0.4 else ()) + tuple(r.choices(b"ab\xc3\xa9", k=r.randrange(1, 6))) for _ in range(size)]
        words = ["".join(r.choices("abé", k=r.randrange(1, 14))) for _ in range(300)]
        data, offsets = K.text_buffers(pa.array(words))
        got = token_count.Automaton(pieces).count(data, offsets[:-1], offsets[1:])
        assert got.tolist() == [greedy(pieces, w) for w in words]
    docs = [(1, "ab ba  ab"), (2, None), (3, " \n"), (4, "é" * 500), (None, "a"), (1, "ab ba  ab")]
    got = token_count.count_pieces(spark.createDataFrame(docs, "doc_id long, text string"), pieces).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_pieces) for x in got) == sorted((str(i), len((t or "").split()), sum(greedy(pieces, w) for w in (t or "").split())) for i, t in docs)


def test_public_vocabulary():
    P = pytest.importorskip("public_tokenizers")
    pieces = token_count.read_pieces(P.path("piece_bpe_32k.model"))
    assert len(pieces) > 30_000
    words = ["the", "International", "xqzj", "日本", "\U0001f600", "don't"]
    data, offsets = K.text_buffers(pa.array(words))
    assert token_count.Automaton(pieces).count(data, offsets[:-1], offsets[1:]).tolist() == [greedy(pieces, w) for w in words]


def all_segments(score):
    """Ruzzo and Tompa by definition: the best run, then the same left and right of it."""
    best = max(((sum(score[a:b]), -(b - a), a, b) for a in range(len(score)) for b in range(a + 1, len(score) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return all_segments(score[:a]) + [(a, b)] + [(x + b, y + b) for x, y in all_segments(score[b:])]


def test_segments_match_definition():
    r = random.Random(2)
    for _ in range(200):
        n = r.randrange(1, 14)
        at = sorted(r.sample(range(n), r.randrange(n + 1)))
        value = [r.randrange(1, 1000) / 7 for _ in at]
        score = [-50.0] * n
        for i, v in zip(at, value):
            score[i] = v
        assert [(a, b) for a, b, _ in toxicity.segments(at, value, -50.0)] == all_segments(score)


def corpus(n=600):
    r = random.Random(9)
    clean, bad = [f"w{i}" for i in range(300)], ["zorg", "blat", "krud"]
    docs, labels = [], []
    for i in range(n):
        x, toxic = r.choices(clean, k=r.choice([8, 40, 120])), r.random() < 0.3
        if toxic:
            at = r.randrange(len(x))
            x[at:at] = r.choices(bad, k=4)
        junk = r.random() < 0.3
        docs.append((i, "$$ ".join(x) + "$$" if junk else " ".join(x).capitalize() + ".", r.choice(["en", "de"]), f"s{i % 5}"))
        labels.append((i, int(not junk), int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = corpus()
    docs += [(9000, None, "en", "s"), (9001, "", "en", "s"), (9001, "", "en", "s"), (None, "zorg blat", "en", "s")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, lang string, source string, score int")
    truth = {i: t for i, _, t in labels}
    got = toxicity.report(df, spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    held = [(truth[x.doc_id], x.predicted) for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)
    hit = next(x for x in got if x.predicted and x.doc_id in truth and truth[x.doc_id])
    text = {d[0]: d[1] for d in docs}[hit.doc_id].lower().replace("$", "").replace(".", "").split()
    assert any(w in text[p["first"] : p["end"]] for p in hit.passages for w in ("zorg", "blat", "krud"))
    assert {x.predicted for x in got if x.doc_id in (9000, 9001)} == {0}
    none = toxicity.report(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {x.score for x in none} == {0.0} and toxicity.report(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_languages(spark):
    r = random.Random(1)
    kinds = {"aa": "abcde", "bb": "defgh", "cc": "ghijk"}
    text = lambda k, n: " ".join("".join(r.choices(kinds[k], k=4)) for _ in range(n))
    docs = [(i, text(k, r.choice([3, 60])), k) for i, k in enumerate(r.choices(list(kinds), k=400))]
    mixed = [(9000, text("aa", 80) + " " + text("cc", 40), None), (9001, None, "aa"), (9002, "12 !?", "aa"), (9003, "", None), (None, text("bb", 50), "bb"), (9004, "é", None)]
    df = spark.createDataFrame([(*d, 1) for d in docs + mixed], "doc_id long, text string, lang string, score int")
    got = {x.doc_id: x for x in language_id.report(df).collect()}
    held = [(x.lang_pred, k) for i, _, k in docs if (x := got[i]).held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(got) == len(docs) + len(mixed)
    assert got[9000].languages == ["aa", "cc"] and abs(got[9000].shares[0] - 2 / 3) < 0.1
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9001, 9002, 9003)) and got[None].lang_pred == "bb" and got[9004].lang_pred in kinds
    unknown = language_id.report(df.withColumn("lang", df.lang.substr(9, 1)).filter("lang IS NULL")).collect()
    assert {x.lang_pred for x in unknown} == {"und"} and language_id.report(df.limit(0)).count() == 0


def test_quality(spark):
    docs, labels = corpus()
    docs += [(9000, None, "en", "s"), (9001, "  ", None, None), (9001, "  ", None, None), (None, "w1 w2 w3", None, "s1")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, source string, keep string")
    known = spark.createDataFrame(labels[:300] + [(2, None, None)], "doc_id long, quality int, toxic int")
    got = quality.assess(df, known).collect()
    truth = {i: bool(q) for i, q, _ in labels[300:]}
    rest = [(truth[x.doc_id], x.keep) for x in got if x.doc_id in truth]
    assert sum(a == b for a, b in rest) >= 0.97 * len(rest) and len(got) == len(docs)
    assert not any(x.keep for x in got if x.doc_id in (9000, 9001))
    kept = quality.keep_good(df, known)
    assert kept.columns == df.columns and kept.count() == sum(x.keep for x in got)
    free = quality.assess(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert free.filter("keep").count() == len(docs) - 3 and quality.assess(df.limit(0), known).count() == 0


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = [("big", "p", -3.0)] * 200 + [("small", "p", -3.0)] + [("ok%d" % (i % 9), "p", 3.0) for i in range(900)]
    table, mean = quality.rates(spark.createDataFrame(rows, "host string, path string, evidence double"))
    got = {x.host: x.path_rate for x in table.collect()}
    assert got["big"] < 0.15 and abs(got["small"] - mean) < abs(got["big"] - mean) and got["ok0"] > 0.9


def test_features_are_finite():
    x, n = quality.features(*K.text_buffers(pa.array(["", "a", " ", "A!! B!!\nA!! B!!", None])))
    assert np.isfinite(x).all() and n.tolist() == [0, 1, 0, 4, 0]


def test_a_text_in_five_languages_gets_its_whole_set(spark):
    r = random.Random(9)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst", "ee": "uvwxy", "ff": "éèàçù"}
    text = lambda a, n: " ".join("".join(r.choices(alphabets[a], k=r.randrange(2, 6))) for _ in range(n))
    rows = [(i, text(a, 60), a) for i, a in enumerate(sorted(alphabets) * 12)]
    rows += [(1000, " ".join(text(a, 50) for a in ("aa", "bb", "cc", "dd", "ee")), None)]
    got = {x.doc_id: x for x in language_id.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sorted(got[1000].languages) == ["aa", "bb", "cc", "dd", "ee"] and got[1000].score < 0.3
    assert all(got[i].languages == [a] for i, _, a in rows[:72])
