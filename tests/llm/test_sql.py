"""Queries with SQL against it: on the smallest tables, and on odd rows."""

import random
from pathlib import Path

import duckdb
import pytest

from sluice.llm import queries

DATA = "/root/testdata/sf0.001"


def compare(spark, name, folder):
    got = queries.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        at = Path(folder) / f"{table}.parquet"
        if not at.exists():
            continue
        con.sql(f"CREATE VIEW {table} AS FROM read_parquet('{at}/*.parquet')" if at.is_dir() else f"CREATE VIEW {table} AS FROM '{at}'")
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_tables(spark, name):
    compare(spark, name, DATA)


def test_odd_rows(spark, tmp_path):
    run = " ".join(f"W{i}é" for i in range(20))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, run), (5, "x y " + run + " tail"), (5, run), (6, "short one"), (7, "Short\x0bONE, short-one"), (None, run), (8, "a " * 30), (9, "b " + "a " * 14)]
    items = [(1, run), (2, "short one"), (3, None), (4, "!?"), (5, "a"), (5, "tail"), (None, "tail"), (6, "a " * 15)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("op2_substring_dedup", "op9_decontamination"):
        compare(spark, name, tmp_path)


def test_near_copies(spark, tmp_path):
    r = random.Random(2)
    docs = [(1, None), (2, ""), (3, "ONE two"), (4, "one\ttwo"), (5, "one two three"), (6, "a " * 40), (7, "a " * 30)]
    for i in range(40):
        x = [f"w{r.randrange(60)}" for _ in range(r.choice([20, 50, 90]))]
        docs.append((100 + 3 * i, " ".join(x)))
        x[r.randrange(len(x))] = "changed"
        docs.append((101 + 3 * i, " ".join(x)))
        docs.append((102 + 3 * i, " ".join(x + [f"t{i}"] * r.randrange(1, 12))))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, "op6_near_dedup", tmp_path)


def test_aliases(spark, tmp_path):
    link, meta = '<LINK rel="x canonical" href="{}">', "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://a.com/en/1", ""), (2, "http://B.org/x/", link.format("http://a.com/en/1#top")), (3, "http://b.org/y?q=1", meta.format("/x/")), (4, "http://c.org/", link.format("//b.org/y?q=1")),
        (5, "http://d.net/deep/page", link.format("other")), (6, "http://d.net/deep/other", link.format("http://www.example.com/en/7")), (7, "http://e.org/es/1", link.format("http://e.org/fr")), (8, "http://e.org/fr", None),
        (9, None, link.format("http://a.com/en/1")), (10, "no scheme", "x"), (11, "http://f.io/?a", link.format("?b&amp;c")), (12, "http://f.io/?b&c", meta.format("http://x.com/en/z")), (13, "http://example.net/de/8/9", "<link rel=canonical href=/de/7>"),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    compare(spark, "op8_url_filter", tmp_path)
