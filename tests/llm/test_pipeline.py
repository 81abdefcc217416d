import random

import pytest

import corpus_pipeline

P = pytest.importorskip("public_tokenizers")


def words(r, n):
    return ["".join(r.choices("abcdefghij", k=r.randrange(2, 8))) for _ in range(n)]


def test_stages(spark, tmp_path):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(160):
        x = words(r, r.choice([60, 150]))
        junk = i % 4 == 3
        docs.append([i, "!!! ".join(x).upper() if junk else " ".join(x).capitalize() + ".", "en", f"s{i % 3}"])
        labels.append((i, int(not junk), 0))
    passage, item = " ".join(words(r, 70)), " ".join(words(r, 30))
    near = docs[40][1].split()
    near[10] = "changed"
    docs[80][1] = docs[40][1]  # an exact copy
    docs[81][1] = docs[81][1] + " " + passage
    docs[82][1] = docs[82][1] + " " + passage + " after"
    docs[84][1] = docs[84][1] + " " + item
    docs += [[500, " ".join(near), "en", "s0"], [501, None, None, None], [502, "", "en", "s1"]]
    rows = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, at = [], rows
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        at = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append(at)
        assert name == "byte_bpe" or at.columns == rows.columns
    ids = [{x.doc_id for x in s.collect()} for s in seen]
    clean = {i for i in range(160) if i % 4 != 3}
    assert ids[0] == clean | {500}
    assert ids[1] == clean - {80}
    texts = {x.doc_id: x.text for x in seen[2].collect()}
    assert texts[82] == docs[82][1].replace(" " + passage, "") and texts[81] == docs[81][1]
    assert all(texts[i] == docs[i][1] for i in ids[1] - {82})
    assert ids[3] == ids[2] - {84} and ids[4] == ids[3]
    import tiktoken

    from sluice.llm.byte_bpe import read_ranks

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {x.doc_id: x.n_tokens for x in at.collect()} == {i: len(e.encode_ordinary(texts[i])) for i in ids[4]}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, at.collect()))


def test_substring_stage_takes_out_passages_of_13_words(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, "a " + passage, 40), (2, "b " + passage + " c", 42), (3, "d " + passage.rsplit(" ", 1)[0], 38)], "doc_id long, text string, n_chars long")
    got = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.substring_stage(spark, docs, "").collect()}
    assert got == {1: ("a " + passage, 40), 2: ("b c", 3), 3: ("d " + passage.rsplit(" ", 1)[0], 38)}
