import random
import re

from sluice.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, w=13):
    windows = []
    for item, text in bench:
        x = words(text)
        if x:
            n = min(w, len(x))
            windows += [(str(item) if item is not None else "null", tuple(x[i : i + n])) for i in range(len(x) - n + 1)]
    out = []
    for doc_id, text in docs:
        x = words(text)
        hit, items = set(), set()
        for item, t in windows:
            for i in range(len(x) - len(t) + 1):
                if tuple(x[i : i + len(t)]) == t:
                    hit.update(range(i, i + len(t)))
                    items.add(item)
        out.append((doc_id, len(x), len(hit), len(items), decontaminate.sha256_of(list(items)), len(hit) > 0 and 20 * len(hit) >= len(x)))
    return sorted(out, key=str)


def cases():
    r = random.Random(3)
    vocabulary = ["the", "of", "Élan", "niño", "x1", "alpha", "Beta", "gamma", "zz"]
    bench = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(20)]
    bench += [(100, None), (101, ""), (102, "..."), (None, "rare unlisted phrase"), (103, bench[0][1]), (104, bench[0][1])]
    docs = []
    for i in range(60):
        body = r.choices([v + str(r.randrange(9)) for v in vocabulary], k=r.randrange(0, 200))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(body) + 1)
            t = words(r.choice(bench)[1] or "")
            body[at:at] = t[r.randrange(3) :] if r.random() < 0.5 else t
        docs.append((i, r.choice([" ", ", ", "\n"]).join(body).upper() if i % 3 else " ".join(body)))
    return docs + [(1000, None), (1001, ""), (1002, "!!!"), (1003, "RARE unlisted-phrase"), (1003, "rare unlisted-phrase"), (None, "the of")], bench


def test_matches_brute_force(spark):
    docs, bench = cases()
    rows = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, n_hit string")
    found = decontaminate.report(rows, spark.createDataFrame(bench, "item_id int, text string")).collect()
    assert sorted([tuple(x)[:6] for x in found], key=str) == brute(docs, bench)


def test_longest_match_and_removal(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a b " + passage + " c", 7), (2, "nothing here", 8), (3, None, 9)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([("q", passage)], "item_id string, text string")
    assert [x.longest_match for x in decontaminate.contamination(docs, bench).orderBy("doc_id").collect()] == [40, 0, 0]
    assert [(x.doc_id, x.item_id) for x in decontaminate.remove_contaminated(docs, bench).orderBy("doc_id").collect()] == [(2, 8), (3, 9)]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.report(docs, bench).count() == 0
    assert decontaminate.report(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).first().n_hit == 0


def in_blocks(monkeypatch, n):
    whole = decontaminate.benchmark_blocks

    def blocks(benchmark):
        items = [x for block in whole(benchmark) for x in block]
        return [items[i::n] for i in range(n)]

    monkeypatch.setattr(decontaminate, "benchmark_blocks", blocks)


def test_several_blocks_match_brute_force(spark, monkeypatch):
    docs, bench = cases()
    docs += [(1004, "one two"), (1004, "six two"), (None, "of the"), (None, bench[6][1]), (None, "same size")]
    rows, items = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id int, text string")
    one = sorted((tuple(x) for x in decontaminate.contamination(rows, items).collect()), key=str)
    in_blocks(monkeypatch, 4)
    assert sorted((tuple(x) for x in decontaminate.contamination(rows, items).collect()), key=str) == one
    assert sorted([tuple(x)[:6] for x in decontaminate.report(rows, items).collect()], key=str) == brute(docs, bench)


def test_words_in_two_blocks_are_hit_once_and_rows_without_id_are_removed(spark, monkeypatch):
    passage = [f"w{i}" for i in range(14)]
    clean = " ".join(passage[:13] + [f"c{i}" for i in range(300)])  # 13 of 313 words, by an item of each block
    docs = [(1, clean), (2, clean), (2, clean), (None, " ".join(passage)), (None, clean)]
    rows = spark.createDataFrame([(a, b, n) for n, (a, b) in enumerate(docs)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(1, " ".join(passage[:13])), (2, " ".join(passage))], "item_id int, text string")
    in_blocks(monkeypatch, 2)
    found = decontaminate.contamination(rows, items).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.contaminated) for x in found) == [("1", 313, 13, False), ("2", 313, 13, False), ("2", 313, 13, False), ("None", 14, 14, True), ("None", 313, 13, False)]
    assert decontaminate.remove_contaminated(rows, items).count() == 0


def test_a_long_document_with_one_passage_goes_and_clean_ones_stay(spark):
    r = random.Random(8)
    item = [f"w{i}" for i in range(15)]
    body = [f"v{r.randrange(900)}" for _ in range(700)]
    docs = [
        (1, " ".join(body[:300] + item + body[300:])), (2, " ".join(body)), (3, " ".join(body[:300] + item[:12] + body[300:])), (None, " ".join(body + item[1:])), (None, " ".join(body)),
        (4, " ".join(["tiny", "item", *body])), (5, "tiny item"), (6, None), (7, ""), (1, "fine"),
    ]
    rows = spark.createDataFrame([(a, b, n) for n, (a, b) in enumerate(docs)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, "tiny item")], "item_id int, text string")
    assert sorted(x.n for x in decontaminate.remove_contaminated(rows, items).collect()) == [1, 2, 4, 5, 7, 8, 9]
