"""Work that must grow no faster than the rows: what is computed once, what is dealt out."""

import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice.functions import fixed, jsonv, text
from sluice.plans import record_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@needs_tables
def test_episodes_of_one_file_are_dealt_out(spark):
    assert record_queries._episodes(False).frame(spark, DATA).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@needs_tables
@pytest.mark.parametrize("query, most", [("episode_rows", 24), ("turn_rows", 24), ("trend_documents", 24), ("manifest_documents", 24)])
def test_kinds_are_found_once(spark, query, most):
    """The kind of a field is found once however many rules ask for it."""
    plan = record_queries.QUERIES[query](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schemaOfVariant(") <= most


def test_known_names_are_no_risk(spark):
    """What the rules leave out of a search finds nothing in it."""
    names = {*fixed.EPISODE_KEYS, *fixed.TURN_FLAG_KEYS, *fixed.TREND_KEYS, *fixed.MANIFEST_KEYS}
    n = F.col("n")
    assert spark.createDataFrame([(x,) for x in sorted(names)], "n string").filter(text.risky_text(n) | text.risky_token(n)).collect() == []
    assert spark.createDataFrame([(x,) for x in fixed.ISSUE_FLAGS], "n string").filter(~text.safe_token(n)).collect() == []


def test_escaped_and_plain_strings(spark):
    json = '{"a\\u0062" : "x\\"y:", "":"", "k:":["\\\\", "ü"]}'
    assert spark.range(1).select(jsonv.deep_keys(F.lit(json)), jsonv.deep_strings(F.lit(json))).first()[:] == (["ab", "", "k:"], ['x"y:', "", "\\", "ü"])


PIECES = [
    "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "http", "ssh", "s", "://", "git", "@", "host", ":", "a.b", ".org", "~", "/", "Users", "ho" + "me", "tmp", ".co" + "dex", "-local", "\\", "archived_", "Sessions", "C:",
    "pass" + "word", "secret", "api", "_key", " key", "token", "credential", "private", "authorization", "=", "'", '"', " ", "\n", "re.compile", "frozenset", "Bearer ", "abcdefgh1234567", "sk", "rk", "-", "_", "proj", "ghp",
    "github_pat", "a" * 16, "f" * 32, "0123abcd", "-89ab-cdef-0123-", "rollout", "-summary", ".jsonl", "10.", "127", "172.16", ".1", ".2.3", "192.168", "100.64", "fe80", "fd", "::1", "episode", "turn", "SESSION", "id", ".",
    "_ref_v1:", "internal", ".corp", ".local", "lan", "x", "é", "凭" + "证", "客户", "生产", "production", "rm -rf", "pii", "\u017f", "\u0131", "\u0130", "\u212a", "\u00a0", "\u0661", ",", "customer data", "tools", "plain words ",
    "C:\\Us" + "ers\\", "https" + "://10.1.2.3", "01234567-89ab-cdef-0123-456789ab", "cdef", "rollout" + "-x", "ssh" + "://me@", "git" + "@host:", "-----BEGIN RSA PRIVATE" + " KEY-----",
]
FORMER_SECRET = r"(?<![A-Za-z0-9_])[\"']?" + fixed.SECRET_NAME


def test_needs_lose_no_hit(spark):
    """Each pattern on many odd texts, with what it needs looked for first and without."""
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    for body in ("tok\u212aen", "\u017fecret", "p\u0131i", "P\u0130I", "to\u212aen = x", "pa\u017f\u017fword: x", "SE\u017f\u017fION ID: abcdef1", "ep\u0131sode_\u0130d_abcdef1", "ROLLOUT-x.JSON\u017f"):
        texts += [body, body.upper(), f"x {body} y"]
    names = list(fixed.PATTERNS)
    t = F.col("t")
    plain = lambda n: F.coalesce(t.rlike(f"(?iuU:{FORMER_SECRET})" if n == "secret_assignment" else text.pattern(n)), F.lit(False))
    df = spark.createDataFrame([(x,) for x in texts], "t string").repartition(4)
    both = df.select("t", F.array_compact(F.array(*(F.when(plain(n), n) for n in names))).alias("want"), text.patterns_in(t, names).alias("got"), text.risky_document(t).alias("risky"), text.risky_text(t).alias("short")).collect()
    assert [r for r in both if r.want != r.got or not r.risky == r.short == any(n in fixed.RETAINED_BANK for n in r.want)] == []
    seen = {n for r in both for n in r.want}
    assert seen == set(names)


def test_letters_of_any_case(spark):
    """All letters that Java takes for one from a to z are one of these when lowered."""
    letters = spark.createDataFrame([(chr(i),) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "c string")
    assert [r.c for r in letters.filter(F.col("c").rlike("(?iuU)[a-z]") & ~text._lower(F.col("c")).rlike("[a-z]")).collect()] == []


def test_long_runs_are_searched_once(spark):
    """Words joined by dots were searched anew from each of them: time grew with the square of their number."""
    long = spark.createDataFrame([("a." * 60_000,), ("a." * 60_000 + " : =",)], "t string").coalesce(1)
    began = time.time()
    assert long.filter(text.risky_document(F.col("t"))).collect() == []
    assert time.time() - began < 20
