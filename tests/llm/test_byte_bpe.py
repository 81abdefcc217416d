import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from sluice.llm import byte_bpe
from sluice.llm import kernel as K

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["it's we'll I'VE o'd're x's's ''s 's '  's", "a  b\n\n c \t d", "  ", " ", "\n", "x \n", "  x", " 　 y", "١٢٣ 12½", "日本語 текст é́", "a" * 3000, "?!  ...\n\n\nb 'sabc 'rest", "'", "'s", "it' s", "<|endoftext|>", "\U0001f600'm \x00\x1f"]


def test_pretokens_are_the_patterns_matches():
    r = random.Random(4)
    texts = ODD + ["".join(r.choices("ab '\n\t1é.!stredvlm ", k=r.randrange(60))) for _ in range(3000)]
    data, offsets = K.text_buffers(pa.array(texts))
    starts, ends, of = byte_bpe.pretokens(data, offsets)
    for i, text in enumerate(texts):
        got = [data[a:b].tobytes().decode() for a, b in zip(starts[of[i] : of[i + 1]], ends[of[i] : of[i + 1]])]
        assert got == regex.findall(P.PATTERN, text), repr(text)


def brute(docs):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return sorted(((i, len(x := e.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in docs), key=str)


def test_matches_tiktoken(spark):
    docs = [(i, t) for i, t in enumerate([*ODD, None, "", *ODD])] + [(3, "again"), (3, "again"), (None, "no id")]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, block string").repartition(3)
    assert sorted((tuple(x) for x in byte_bpe.report(df, RANKS).collect()), key=str) == brute(docs)
    assert byte_bpe.report(df.limit(0), RANKS).count() == 0
    again = byte_bpe.decode(byte_bpe.encode(df.filter("doc_id > 3"), RANKS), RANKS).collect()
    assert sorted(bytes(x.bytes) for x in again) == sorted((t or "").encode() for i, t in docs if i is not None and i > 3)


def test_lacking_words_are_encoded_on_the_spot():
    ranks = byte_bpe.read_ranks(RANKS)
    words = byte_bpe._Dictionary([], byte_bpe._encoder(ranks))
    data, offsets = K.text_buffers(pa.array(["one two two", "three"]))
    starts, ends, _ = byte_bpe.pretokens(data, offsets)
    where = words.find(K.hash_spans(data, starts, ends), data, starts, ends)
    ids = words.ids[K.spread(words.begin[where], words.counts[where])].astype(np.int64)
    back = {i: t for t, i in ranks.items()}
    assert b"".join(back[i] for i in ids.tolist()) == b"one two twothree"
