"""The queries of this subpackage for __spark_entry__.py, one per operator, over whole tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from sluice.llm import byte_bpe, decontaminate, fingerprint, language_id, near_dedup, quality, substring_dedup, token_count, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_pieces(table(spark, sf_dir, "documents"), token_count.read_pieces(tokenizer("piece_bpe_32k.model")))


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.report(table(spark, sf_dir, "documents"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_count": op3_token_count,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_fingerprint": op10_fingerprint,
}

#: Windows of 13 words by their digest; a window goes where its first document is another with a smaller id.
OP2 = r"""WITH doc AS (SELECT row_number() OVER () AS d, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT d, doc_id, p, md5(array_to_string(list_slice(w, p, p + 12), ' ')) AS h FROM (SELECT d, doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM doc WHERE len(w) >= 13)),
earliest AS (SELECT h, min(doc_id) AS least FROM win GROUP BY 1),
gone AS (SELECT DISTINCT d, unnest(range(p, p + 13)) AS p FROM win JOIN earliest USING (h) WHERE least < doc_id),
kept AS (SELECT d, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM (SELECT d, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM doc) ANTI JOIN gone USING (d, p) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (d)"""

#: Windows of items joined to the documents' runs of words that begin with the same word.
OP9 = r"""WITH item AS (SELECT row_number() OVER () AS i, coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc AS (SELECT row_number() OVER () AS d, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
wanted AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, p, p + least(13, len(w)) - 1) AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM item WHERE len(w) > 0)),
place AS (SELECT d, w, unnest(range(1, len(w) + 1)) AS p FROM doc),
shown AS (SELECT d, p, n, list_slice(w, p, p + n - 1) AS words FROM place JOIN (SELECT DISTINCT n, words[1] AS first FROM wanted) ON w[p] = first WHERE p + n - 1 <= len(w)),
found AS (SELECT d, p, n, item_id FROM shown JOIN wanted USING (n, words)),
hit AS (SELECT d, count(DISTINCT q) AS n_hit FROM (SELECT d, unnest(range(p, p + n)) AS q FROM found) GROUP BY 1),
items AS (SELECT d, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM doc LEFT JOIN hit USING (d) LEFT JOIN items USING (d)"""

#: All pairs of sets that share a shingle, and what is reachable over those that are alike enough.
OP6 = r"""WITH RECURSIVE doc AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM doc),
each AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
half AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reached(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT b, c FROM reached JOIN links ON doc_id = a)
SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM sets JOIN reached USING (doc_id) GROUP BY doc_id"""


def _op8() -> str:
    """Rules of hosts and paths, and of what redirects and canonical links reach."""
    rules = ", ".join(f"({a == 'allow'}, '{h}', '{p}')" for a, h, p in url_filter.RULES).replace("True", "TRUE").replace("False", "FALSE")
    rule = lambda host, path: f"(SELECT max({{'length': length(h || p), 'allow': allow, 'rule': h || p}}) FROM rules WHERE ({host} = h OR ends_with({host}, '.' || h)) AND starts_with({path}, p))"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = lambda url: f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    host, path = lambda x: lower(f"regexp_extract({x}, '^([^/?#]*)', 1)"), lambda x: f"regexp_extract({x}, '^[^/?#]*([^?#]*)', 1)"
    address = lambda x: f"CASE WHEN {host(x)} <> '' THEN {host(x)} || regexp_extract({x}, '^[^/?#]*([^#]*)', 1) END"
    quoted = lambda name, q: f"""regexp_extract(tag, '(?i)[\\s"''/]{name}\\s*=\\s*{q}', 1)"""
    attribute = lambda name: "trim(coalesce(" + ", ".join(f"nullif({quoted(name, q)}, '')" for q in ('"([^"]*)"', "''([^'']*)''", """([^\\s"''>]+)""")) + ", ''))"
    target = f"""CASE WHEN {lower("substr(tag, 2, 4)")} = 'link' AND regexp_matches({attribute("rel")}, '(?i)(^|\\s)canonical(\\s|$)') THEN {attribute("href")}
WHEN regexp_full_match({attribute("http-equiv")}, '(?i)refresh') THEN regexp_extract({attribute("content")}, '(?i)^[^;,]*[;,]\\s*url\\s*=\\s*[''"]?([^''"]*)', 1) END"""
    site = "regexp_extract(url, '^([^:]*://[^/?#]*)', 1)"
    full = f"""CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:]*):', 1) || ':' || t WHEN starts_with(t, '/') THEN {site} || t
WHEN regexp_matches(t, '^[?#]') THEN regexp_extract(url, '^([^:]*://[^?#]*)', 1) || t ELSE {site} || coalesce(nullif(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*/)', 1), ''), '/') || t END"""
    return f"""WITH RECURSIVE rules(allow, h, p) AS (VALUES {rules}), page AS (SELECT page_id, url, html, {rest("url")} AS rest FROM pages),
own AS (SELECT page_id, {host("rest")} AS host, {path("rest")} AS path, {address("rest")} AS address FROM (SELECT page_id, coalesce(rest, '') AS rest FROM page)),
tag AS (SELECT url, rest, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\s[^>]*>')) AS tag FROM page),
linked AS (SELECT url, rest, replace({target}, '&amp;', '&') AS t FROM tag), found AS (SELECT rest, {full} AS to_url FROM linked WHERE t <> ''),
pair AS (SELECT {address("rest")} AS a, {address("to_rest")} AS b FROM (SELECT rest, {rest("to_url")} AS to_rest FROM found)),
edge AS (SELECT a, b FROM pair WHERE a <> b UNION SELECT b, a FROM pair WHERE a <> b),
reached(node, other) AS (SELECT a, a FROM edge UNION SELECT b, other FROM reached JOIN edge ON node = a),
class AS (SELECT r.other AS address, max(n.r.allow) AS allow FROM reached r JOIN (SELECT a AS node, {rule(host("a"), path("a"))} AS r FROM (SELECT DISTINCT a FROM edge)) n ON n.node = r.node GROUP BY 1),
judged AS (SELECT own.*, {rule("host", "path")} AS r FROM own)
SELECT page_id, host, path, r.rule AS rule, CASE WHEN coalesce(r.allow, class.allow, TRUE) THEN 'allow' ELSE 'block' END AS verdict, r IS NULL AND class.allow IS NOT NULL AS by_alias FROM judged LEFT JOIN class ON class.address = judged.address"""


#: The others' models, sketches and encodings are not SQL's; tests/llm holds them against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2, "op6_near_dedup": OP6, "op8_url_filter": _op8(), "op9_decontamination": OP9}
