"""URL filters with redirect equivalence, in DataFrame operations only.

A page redirects by ``<meta http-equiv="refresh" content="...; url=...">`` and names its canonical address by
``<link rel="canonical" href="...">``. Addresses joined by such edges, directly or over others, are aliases: one
connected component. Rules decide an address by its host and path; an address without a rule of its own takes its
class's decision: allow if any alias has an allow rule (explicit allow goes first), else block if any has a block rule,
else allow. An address is its host (A-Z lower-cased), path and query: scheme and fragment do not tell addresses apart.

Nulls and odd input: a null url or one without ``://`` has an empty host and path, no rule and no aliases; a null html
has no edges; edges to addresses outside the table count, with the rules of these addresses; repeated rows stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import components
from sluice.llm.shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path): a rule fits its host and all its subdomains, for paths that start with its path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def address_of(url: Column) -> Column:
    """What tells addresses apart; null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(_rest(url), r"\A[^/?#]*([^#]*)", 1)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(length, allow, rule) of the longest rule that fits, null without one; of equally long ones allow goes first."""
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(action == "allow").alias("allow"), F.lit(h + p).alias("rule")))
        for action, h, p in rules
    ]
    return reduce(F.greatest, fits) if len(fits) > 1 else fits[0] if fits else F.lit(None).cast("struct<length:int,allow:boolean,rule:string>")


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value: in either quotes, or bare."""
    quoted, single, bare = (F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*{q}", 1) for q in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)"))
    return F.trim(F.when(quoted != "", quoted).when(single != "", single).otherwise(bare))


def _resolved(base: Column, to: Column) -> Column:
    """An absolute url for a reference in a page."""
    scheme, host = F.regexp_extract(base, r"\A([^:]*)://", 1), F.regexp_extract(base, r"\A[^:]*://([^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"\A[^:]*://[^/?#]*([^?#]*)", 1), r"[^/]*\z", "")
    to = F.regexp_replace(to, "&amp;", "&")
    return (
        F.when(to.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(scheme, F.lit("://"), host, to))
        .when(to.rlike(r"\A[?#]"), F.concat(scheme, F.lit("://"), host, F.regexp_extract(base, r"\A[^:]*://[^/?#]*([^?#]*)", 1), to))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.when(folder == "", "/").otherwise(folder), to))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): addresses that redirect or canonical-link edges of the pages (url, html) join."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)(<(?:link|meta)\s[^>]*>)"), 1)
    marked = F.filter(tags, lambda t: t.rlike(r"(?i)canonical|refresh"))
    found = pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(marked).alias("tag"))
    link = (F.translate(F.substr("tag", F.lit(2), F.lit(4)), UPPER, LOWER) == "link") & _attribute(F.col("tag"), "rel").rlike(r"(?i)(\A|\s)canonical(\s|\z)")
    meta = _attribute(F.col("tag"), "http-equiv").rlike(r"(?i)\Arefresh\z")
    target = F.when(link, _attribute(F.col("tag"), "href")).when(meta, F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)\A[^;,]*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1))
    found = found.select("url", target.alias("target")).filter("target <> ''")
    found = found.select(address_of(F.col("url")).alias("a"), address_of(_resolved(F.col("url"), F.col("target"))).alias("b"))
    return found.filter("a <> b").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, url's host and path, rule, verdict, and by_alias (the verdict comes from an alias's rule).

    rules is a short policy, compiled into one expression. edges (a, b) of addresses may come from a crawl's redirect log;
    else they are read from the pages.
    """
    url = F.col("url")
    rows = pages.select("page_id", url.cast("string").alias("url"))
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), address_of(url).alias("address"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    edges = cut(edges if edges is not None else alias_edges(pages.select(url.cast("string").alias("url"), F.col("html").cast("string").alias("html"))))
    if edges.isEmpty():
        joined = rows.withColumn("class_allow", F.lit(None).cast("boolean"))
    else:
        member = components(edges)
        at = F.concat(F.lit("x://"), F.col("node"))
        ruled = member.withColumn("own", rule_of(host_of(at), path_of(at), rules)).groupBy("component").agg(F.max("own.allow").alias("class_allow"))
        decided = member.join(ruled.filter("class_allow IS NOT NULL"), "component").select(F.col("node").alias("address"), "class_allow")
        joined = rows.join(decided, "address", "left")
    allow = F.coalesce("own.allow", "class_allow", F.lit(True))
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"), (F.col("own").isNull() & F.col("class_allow").isNotNull()).alias("by_alias"))
