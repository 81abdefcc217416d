"""The gate over a tree of retained artifacts: one ordered table of issues, and a verdict.

Phases: 1 file by file, in path order; 2 flat export directories; 3 month partitions. Within an artifact issues keep the order of its
rules. Messages never repeat a key or a sensitive part of a path. Departures from a line-by-line interpreter, all on input that is
invalid anyway: parser texts are "not strict JSON"; a list where a name is expected is an ordinary issue; year 0000 is no timestamp.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import fixed, jsonv, paths, times
from sluice.functions.text import LINE_END, infrastructure_risk, risky_policy_text, risky_text, risky_token
from sluice.operators import checks
from sluice.plans import rules
from sluice.sources import tree

ISSUES = "phase int, place string, path string, line int, ordinal int, rule int, message string"
DECODE_ERROR = "UnicodeDecodeError: failed to decode as UTF-8"
JSON_ERROR = "JSONDecodeError: not strict JSON"
EVIDENCE = "retained text contains raw/sensitive evidence"


def _route(path: Column, parts: Column, suffix: Column) -> Column:
    """What is done with an artifact, by its suffix and place."""
    kept = F.get(parts, F.lit(0)).isin("data", "reports")
    return (
        F.when(suffix == ".json", "json").when(suffix == ".jsonl", "jsonl")
        .when(kept & suffix.isin(".md", ".txt"), "text").when(kept, "odd_suffix")
        .when(~paths.infrastructure(path, parts), "odd_place").otherwise("infrastructure")
    )


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """The listing with all that paths decide, and the content of files that may be looked into."""
    parts = F.col("parts")
    files = tree.listing(spark, root).select(
        "*", paths.shown(parts).alias("shown"), paths.forbidden(parts).alias("forbidden"), paths.infrastructure(F.col("path"), parts).alias("infrastructure"),
        paths.kind(parts).alias("kind"), paths.export_key(parts).alias("export_key"), paths.month_key(parts).alias("month_key"), _route(F.col("path"), parts, F.col("suffix")).alias("route"),
    )
    barred = files.filter("is_symlink OR forbidden").selectExpr("*", "CAST(NULL AS BINARY) AS content", "CAST(NULL AS STRING) AS read_error")
    read = tree.with_content(files.filter("NOT is_symlink AND NOT forbidden"), root)
    raw = F.col("content").cast("string")
    texts = barred.unionByName(read).withColumn("text", F.when(F.is_valid_utf8(raw), raw)).drop("content")
    parsed = texts.withColumn("doc", F.when(F.col("route") == "json", jsonv.strict(F.col("text"))))
    return _deep(parsed, F.when(F.col("doc").isNotNull(), F.col("text")))


def _deep(df: DataFrame, json: Column) -> DataFrame:
    """df with the keys and the string values at any depth."""
    return df.withColumn("deep_keys", jsonv.deep_keys(json)).withColumn("deep_strings", jsonv.deep_strings(json))


def json_lines(files: DataFrame) -> DataFrame:
    """(path, kind, keys, line, row, object_row, doc, json, bad) of the non-blank lines: line counts all lines, row the non-blank ones, object_row the objects among them."""
    lines = files.filter("route = 'jsonl' AND text IS NOT NULL").select("path", "shown", "kind", "export_key", "month_key", F.posexplode(F.split("text", LINE_END)).alias("at", "json"))
    lines = lines.filter(F.col("json").rlike(r"(?U)\S")).withColumn("doc", jsonv.strict(F.col("json"))).withColumn("deep_keys", jsonv.deep_keys(F.when(F.col("doc").isNotNull(), F.col("json"))))
    by_file = Window.partitionBy("path").orderBy("at")
    numbered = lines.select("*", (F.col("at") + 1).alias("line"), F.row_number().over(by_file).alias("row"))
    is_object = (jsonv.kind(F.col("doc")) == "OBJECT").cast("int")
    # one bad line gives up the whole file
    return numbered.withColumn("first_bad", F.min(F.when(F.col("doc").isNull(), F.col("line"))).over(Window.partitionBy("path"))).withColumn("object_row", F.when(is_object == 1, F.sum(is_object).over(by_file)))


def _found(df: DataFrame, phase: int, place: Column, path: Column, line: Column, messages: Column, base: Column | int = 0) -> DataFrame:
    base = F.lit(base) if isinstance(base, int) else base
    return df.select(F.lit(phase).alias("phase"), place.alias("place"), path.alias("path"), line.cast("int").alias("line"), F.posexplode(messages).alias("at", "message")).select("phase", "place", "path", "line", (F.col("at") + base).cast("int").alias("ordinal"), F.lit(0).alias("rule"), "message")


def file_issues(files: DataFrame, rows: DataFrame) -> DataFrame:
    text, kept_scan = F.col("text"), F.when(F.col("path").isin(fixed.POLICY_DOCS), risky_policy_text(F.col("text"))).otherwise(risky_text(F.col("text")))
    none = F.array().cast("array<string>")
    one = lambda c, m: F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(m))).otherwise(none)
    infra = "infrastructure text contains raw/sensitive evidence"
    scanned = one(F.col("infrastructure") & infrastructure_risk(text), infra)
    doc, keys, strings = F.col("doc"), F.col("deep_keys"), F.col("deep_strings")
    decoded = one(F.col("infrastructure") & (F.exists(keys, infrastructure_risk) | F.exists(strings, infrastructure_risk)), infra)
    unexpected = F.concat(F.array(F.lit("unexpected JSON artifact")), one(F.exists(keys, lambda k: risky_text(k) | risky_token(k)), "JSON key contains raw/sensitive evidence"), one(F.exists(strings, risky_text), EVIDENCE))
    folder = F.when(F.col("export_key").isNotNull(), F.get(F.col("parts"), F.lit(1)))
    json = F.when(doc.isNull(), F.array(F.lit(JSON_ERROR))).otherwise(F.concat(decoded, F.when(F.col("kind").isin("trend", "manifest"), rules.document_issues(F.col("kind"), doc, keys, strings, folder)).when(~F.col("infrastructure") | F.get(F.col("parts"), F.lit(0)).isin("data", "reports"), unexpected).otherwise(none)))
    prose = F.concat(one(~paths.text_report(F.col("path"), F.col("parts")), "unexpected retained text artifact location"), one(kept_scan, EVIDENCE))
    odd_suffix = F.concat(F.array(F.lit("unexpected retained artifact suffix")), one(risky_text(text), EVIDENCE))
    odd_place = F.concat(F.array(F.lit("unexpected retained artifact location")), one(F.col("suffix").isin(fixed.TEXT_SUFFIXES) & risky_text(text), EVIDENCE))
    lenient = F.col("route").isin("odd_suffix", "odd_place") & ~F.col("infrastructure")
    by_route = F.when(F.col("route") == "json", json).when(F.col("route") == "text", prose).when(F.col("route") == "odd_suffix", odd_suffix).when(F.col("route") == "odd_place", odd_place).otherwise(none)
    unread = F.when(F.col("read_error").isNotNull(), F.array("read_error")).when(F.col("text").isNull() & ~lenient & ((F.col("route") != "infrastructure") | F.col("infrastructure")), F.array(F.lit(DECODE_ERROR)))
    said = F.when(F.col("is_symlink"), F.array(F.lit("symlink artifact is not allowed"))).when(F.col("forbidden"), F.array(F.lit("forbidden raw/transient artifact"))).when(unread.isNotNull(), unread).otherwise(F.concat(scanned, by_route))
    whole = _found(files, 1, F.col("path"), F.col("shown"), F.lit(None), said)
    bad = rows.filter("first_bad = line")
    broken = _found(bad, 1, F.col("path"), F.col("shown"), F.lit(None), F.array(F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": invalid JSONL: not strict JSON"))), 1000)
    lost = files.filter("route = 'jsonl' AND kind IS NULL AND text IS NOT NULL").join(bad.select("path"), "path", "left_anti")
    misplaced = _found(lost, 1, F.col("path"), F.col("shown"), F.lit(None), F.array(F.lit("unexpected JSONL artifact")), 1000)
    good = rows.filter("first_bad IS NULL AND kind IS NOT NULL")
    in_rows = _found(good, 1, F.col("path"), F.col("shown"), F.col("row"), rules.row_issues(F.col("kind"), F.col("doc"), F.col("deep_keys")))
    return whole.unionByName(broken).unionByName(misplaced).unionByName(in_rows)


def _text(name: str) -> Column:
    return jsonv.text(jsonv.field(F.col("doc"), name))


def _entries(df: DataFrame, name: str) -> DataFrame:
    """(part, key, n) of a declared count map, of partitions where it is one throughout."""
    value = jsonv.field(F.col("doc"), name)
    good = (jsonv.kind(value) == "OBJECT") & F.forall(jsonv.entries(value), lambda e: jsonv.count(e["value"]).isNotNull())
    return df.filter(good).select("part", F.explode(jsonv.entries(value)).alias("e")).select("part", F.col("e.key").alias("key"), jsonv.count(F.col("e.value")).alias("n"))


def consistency(part: str, phase: int, base: int, files: DataFrame, rows: DataFrame, month: bool) -> DataFrame:
    """The cross-table rules of the partitions named by the column ``part``."""
    objects = rows.filter(F.col(part).isNotNull() & F.col("first_bad").isNull() & F.col("object_row").isNotNull()).withColumnRenamed(part, "part")
    epi = objects.filter("kind = 'episode'").select("part", "shown", "doc", F.col("object_row").alias("i"), _text("episode_id").alias("id"), F.to_json(jsonv.field(F.col("doc"), "host")).alias("host"), F.to_json(jsonv.field(F.col("doc"), "session_id")).alias("session"), times.key(_text("start")).alias("s"), times.key(_text("end")).alias("e"), jsonv.count(jsonv.field(F.col("doc"), "turn_count")).alias("turns"))
    turn = objects.filter("kind = 'turn_flag'").select("part", "shown", "doc", F.col("object_row").alias("i"), _text("turn_id").alias("turn_id"), _text("episode_id").alias("id"), F.to_json(jsonv.field(F.col("doc"), "host")).alias("host"), F.to_json(jsonv.field(F.col("doc"), "session_id")).alias("session"), times.key(_text("timestamp")).alias("t"))
    docs = files.filter(F.col(part).isNotNull() & (F.col("route") == "json") & F.col("kind").isin("trend", "manifest") & F.col("text").isNotNull()).select(F.col(part).alias("part"), "kind", "shown", "doc")
    docs = docs.filter(jsonv.kind(F.col("doc")) == "OBJECT").withColumn("w", rules.window_identity(F.col("doc")))
    trends, manifests = docs.filter("kind = 'trend'"), docs.filter("kind = 'manifest'")
    out: list[DataFrame] = []

    def said(df: DataFrame, step: int, message: str | Column, line: str | None = "i", rule: int | Column = 0) -> None:
        """Issues of a step come line by line, those of a line by rule."""
        message, rule = (F.lit(x) if not isinstance(x, Column) else x for x in (message, rule))
        out.append(df.select(F.lit(phase).alias("phase"), F.col("part").alias("place"), F.col("shown").alias("path"), (F.col(line) if line else F.lit(None)).cast("int").alias("line"), F.lit(base + step).alias("ordinal"), rule.cast("int").alias("rule"), message.alias("message")))

    known_e, known_t = epi.filter(F.col("id").rlike(fixed.EPISODE_REF)), turn.filter(F.col("turn_id").rlike(fixed.TURN_REF))
    said(checks.duplicates(known_e, ["part", "id"], ["i"]), 1, "duplicate episode_id")
    said(checks.duplicates(known_t, ["part", "turn_id"], ["i"]), 2, "duplicate turn_id")
    first = checks.first_wins(known_e, ["part", "id"], ["i"])
    referring = turn.filter(F.col("id").rlike(fixed.EPISODE_REF))
    said(checks.orphans(referring, first, ["part", "id"]), 3, "episode_id is missing from episodes export")
    both = referring.join(first.select("part", "id", F.col("host").alias("e_host"), F.col("session").alias("e_session"), "s", "e", "turns"), ["part", "id"])
    null = lambda c: F.when(F.col(c) != "null", F.col(c))  # noqa: E731  a missing and a null field agree
    said(both.filter(~null("host").eqNullSafe(null("e_host"))), 3, "host must match referenced episode", rule=1)
    said(both.filter(~null("session").eqNullSafe(null("e_session"))), 3, "session_id must match referenced episode", rule=2)
    said(both.filter(checks.outside(F.col("t"), F.col("s"), F.col("e"))), 3, "timestamp must be within referenced episode", rule=3)
    turn_file = turn.groupBy("part").agg(F.min("shown").alias("shown"))
    over = checks.above_limit(referring, ["part", "id"], first.select("part", "id", "turns"), "turns")
    said(over.join(turn_file, "part"), 6, "flagged turns must not exceed referenced episode turn_count", None)
    bounds = trends.select("part", F.col("w"), F.lit(0).alias("rank"), F.lit("trend window").alias("label"))
    if month:
        bounds = bounds.unionByName(manifests.select("part", "w", F.lit(1).alias("rank"), F.lit("manifest window").alias("label")))
    bounds = bounds.filter("w IS NOT NULL").groupBy("part").agg(F.min(F.struct("rank", "label", "w")).alias("b")).select("part", "b.label", "b.w")
    if month:
        y, m = F.split("part", "/")[1], F.split("part", "/")[2]
        begin, end = times.month_bounds(y, m)
        at, trend_first = docs.filter("w IS NOT NULL"), (F.col("kind") != "trend").cast("int")
        said(at.filter((F.col("w.start") >= end) | (F.col("w.end") <= begin)), 7, "window must overlap data month", None, trend_first)
        said(at.filter((F.col("w.start") < end) & (F.col("w.end") > end)), 7, "window end must be within data month", None, trend_first)
        crossing = bounds.filter(F.col("w.mode").isin("weekly", "baseline-90d") & (F.col("w.start") < begin) & (F.col("w.end") <= end)).select("part")
        held_e, held_t = epi.join(crossing, "part", "left_anti"), turn.join(crossing, "part", "left_anti")
        said(held_e.filter(checks.outside(F.col("s"), begin, end, False) | checks.outside(F.col("e"), begin, end)), 8, "episode start/end must be within data month")
        said(held_t.filter(checks.outside(F.col("t"), begin, end, False)), 9, "timestamp must be within data month")
    in_e, in_t = epi.join(bounds, "part"), turn.join(bounds, "part")
    within = lambda what: F.concat(F.lit(f"{what} must be within "), F.col("label"))
    said(in_e.filter(checks.outside(F.col("s"), F.col("w.start"), F.col("w.end"), False) | checks.outside(F.col("e"), F.col("w.start"), F.col("w.end"))), 10, within("episode start/end"))
    said(in_t.filter(checks.outside(F.col("t"), F.col("w.start"), F.col("w.end"), False)), 11, within("timestamp"))
    sums_e = epi.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("turns").alias("total"), F.count("turns").alias("known"))
    sums_t = turn.groupBy("part").agg(F.count(F.lit(1)).alias("flagged"))
    joined = trends.join(sums_e, "part", "left").join(sums_t, "part", "left")
    declared = lambda k: jsonv.count(jsonv.field(F.col("doc"), k))
    n, flagged, total = (F.coalesce(c, F.lit(0)) for c in ("n", "flagged", "total"))
    whole = F.coalesce(F.col("known") == F.col("n"), F.lit(True))
    said(joined.filter(declared("episode_count") != n), 12, "episode_count must match episodes.jsonl", None)
    said(joined.filter(declared("flagged_turn_count") != flagged), 13, "flagged_turn_count must match turn_flags.jsonl", None)
    said(joined.filter(whole & (declared("turn_count") != total)), 14, "turn_count must match episodes.jsonl turn_count total", None)
    sound = joined.filter(whole).select("part").distinct()
    flags = turn.select("part", F.explode(F.array_distinct(F.transform(jsonv.items(jsonv.field(F.col("doc"), "issue_flags")), jsonv.text))).alias("key"))
    actual = {
        "hosts": checks.nonzero_sums(epi.withColumn("key", _text("host")).filter(F.col("key").isin(fixed.EVIDENCE_HOSTS)), ["part", "key"], "turns"),
        "model_eras": checks.nonzero_sums(epi.withColumn("key", _text("model_era")).filter(F.col("key").isin(fixed.MODEL_ERAS)), ["part", "key"], "turns"),
        "flags": flags.filter(F.col("key").isin(fixed.ISSUE_FLAGS)).groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")),
    }
    for step, (name, expected) in enumerate(actual.items(), 15):
        value = jsonv.field(F.col("doc"), name)
        declaring = trends.filter((jsonv.kind(value) == "OBJECT") & F.forall(jsonv.entries(value), lambda e: jsonv.count(e["value"]).isNotNull())).select("part", "shown")
        if name != "flags":
            declaring = declaring.join(sound, "part", "left_semi")
        wrong = checks.reconcile(_entries(trends, name), expected, ["part", "key"]).select("part").distinct()
        source = "turn_flags.jsonl issue_flags" if name == "flags" else "episodes.jsonl turn_count totals"
        said(declaring.join(wrong, "part", "left_semi"), step, f"{name} must match {source}", None)
    pair = trends.select("part", F.col("w").alias("tw"), F.col("doc").alias("td")).join(manifests.select("part", F.col("w").alias("mw"), F.col("doc").alias("md")), "part").withColumn("shown", F.col("part"))
    if not month:
        modes = pair.select("part", "shown", jsonv.text(jsonv.field(jsonv.field(F.col("td"), "window"), "mode")).alias("a"), jsonv.text(jsonv.field(F.col("md"), "mode")).alias("b"))
        said(modes.filter("a <> '' AND b <> '' AND a <> b"), -2, "retained export mode differs between trend and manifest", None)
    said(pair.filter("tw <> mw"), -1, "retained export window differs between trend and manifest", None)
    result = out[0]
    for df in out[1:]:
        result = result.unionByName(df)
    return result


def incomplete_exports(files: DataFrame) -> DataFrame:
    found = checks.incomplete(files.filter("export_key IS NOT NULL"), "export_key", "name", fixed.EXPORT_FILES)
    return found.selectExpr("2 AS phase", "export_key AS place", "export_key AS path", "CAST(NULL AS INT) AS line", "0 AS ordinal", "0 AS rule", "'retained export directory is incomplete or has extra files' AS message")


def issues(spark: SparkSession, root: str) -> DataFrame:
    """All issues of the tree in order: (phase, place, path, line, ordinal, rule, message)."""
    if not os.path.isdir(root):
        return spark.createDataFrame([(0, "", None, None, 0, 0, "root must be an existing directory")], ISSUES)
    root = os.path.realpath(root)
    files = artifacts(spark, root).persist()
    rows = json_lines(files).persist()
    every = file_issues(files, rows).unionByName(incomplete_exports(files))
    every = every.unionByName(consistency("export_key", 2, 10, files, rows, False)).unionByName(consistency("month_key", 3, 10, files, rows, True))
    return every.orderBy("phase", F.split("place", "/"), F.when(F.col("phase") == 1, F.coalesce("line", F.lit(0))).otherwise(0), "ordinal", F.col("line").asc_nulls_first(), "rule", "message")


def display(issue) -> str:
    at = "" if issue.line is None else f":{issue.line}"
    return issue.message if issue.path is None else f"{issue.path}{at}: {issue.message}"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Check a tree of retained artifacts.")
    parser.add_argument("--root", default=".")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("gate").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = [display(x) for x in issues(spark, args.root).collect()]
    print("\n".join(found) if found else "retained history is valid")
    return 1 if found else 0


if __name__ == "__main__":
    raise SystemExit(main())
