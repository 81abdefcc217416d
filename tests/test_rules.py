"""Row rules, one record a case, all in one pass for each kind."""

import json

import fixtures as X
from pyspark.sql import functions as F

from sluice.functions import fixed, jsonv, paths, text, times
from sluice.streaming.records import record_issues

LONG = "x" * 1201
URL, KEY, MAIL = "http" + "s://a.b/c", "-----BEGIN RSA PRIVATE" + " KEY-----", "some" + "one@" + "mail.org"
E, T, D, M = X.EPISODE, X.TURN, X.TREND, X.MANIFEST
FLAG = fixed.ISSUE_FLAGS


def source(**k):
    return X.changed(M, sources=[X.changed(M["sources"][0], **k)])


def window(record=D, **k):
    return X.changed(record, window=X.changed(X.window(), **k))


CASES = [
    ("episode", E, []),
    ("episode", [1], ["episode row must be an object"]),
    ("episode", X.changed(E, extra=1), ["unexpected field is not allowed"]),
    ("episode", X.changed(E, topic=..., cwd=...), ["missing required field: cwd", "missing required field: topic", "topic must be retained text"]),
    ("episode", X.changed(E, host=...), ["missing required field: host", "host must be an allowed retained host"]),
    ("episode", X.changed(E, extra={"deep": [{"path": 1}]}), ["unexpected field is not allowed", "episode contains raw root/path field"]),
    ("episode", X.changed(E, extra={"mytoken": 1}), ["unexpected field is not allowed"]),
    ("episode", X.changed(E, extra={"my.token": 1}), ["unexpected field is not allowed", "episode JSON key contains raw/sensitive evidence"]),
    ("episode", X.changed(E, episode_id="episode_ref_v1:" + "a" * 20 + "\n", session_id=7), ["episode_id must be episode_ref_v1", "session_id must be session_ref_v1"]),
    ("episode", X.changed(E, start="2031-02-29T00:00:00Z"), ["start must be timestamp or null"]),
    ("episode", X.changed(E, start=X.at("11:00:00.000000002"), end=X.at("11:00:00.000000001")), ["episode start must be before or equal to end"]),
    ("episode", X.changed(E, start=None, end=None, work_report_hint="fine"), []),
    ("episode", X.changed(E, turn_count=True), ["turn_count must be a bounded non-negative integer"]),
    ("episode", X.changed(E, turn_count=1.0), ["turn_count must be a bounded non-negative integer"]),
    ("episode", X.changed(E, turn_count=1_000_001, model_era="x", outcome=["needs_review"]), ["model_era must be an allowed retained model era", "turn_count must be a bounded non-negative integer", "outcome is invalid"]),
    ("episode", X.changed(E, topic=LONG), ["topic contains retained-text risk"]),
    ("episode", X.changed(E, topic=URL, work_report_hint=KEY), ["topic contains retained-text risk", "work_report_hint contains retained-text risk"]),
    ("episode", X.changed(E, friction_flags=[FLAG[0], FLAG[0], "no"]), ["friction_flags must not contain duplicate issue flags"]),
    ("episode", X.changed(E, friction_flags=[FLAG[0], "no", "no"]), ["friction_flags must use allowed issue flags"]),
    ("episode", X.changed(E, friction_flags=[["a"]]), ["friction_flags must be safe-token array", "friction_flags must use allowed issue flags"]),
    ("episode", X.changed(E, friction_flags=["a"] * 17), ["friction_flags must contain at most 16 items", "friction_flags must use allowed issue flags"]),
    ("episode", X.changed(E, friction_flags={}), ["friction_flags must be safe-token array"]),
    ("turn_flag", T, []),
    ("turn_flag", X.changed(T, issue_flags=[]), ["issue_flags must contain at least 1 item"]),
    ("turn_flag", X.changed(T, model=fixed.MODEL_IDS[3], timestamp=None, prompt_improvement="more"), []),
    ("turn_flag", X.changed(T, model="other", source_hash="x", assistant_action_summary=None), ["source_hash must be source_hash_v1", "model must be an allowed retained model id or null", "assistant_action_summary must be retained text"]),
    ("turn_flag", X.changed(T, redacted_user_prompt_summary=MAIL), ["redacted_user_prompt_summary contains retained-text risk"]),
    ("trend", D, []),
    ("trend", X.changed(D, schema_version=True), ["trend schema_version must be 1"]),
    ("trend", X.changed(D, flagged_turn_count=4), ["flagged_turn_count must be less than or equal to turn_count"]),
    ("trend", X.changed(D, hosts={"nowhere": 1, "local": "1"}, flags={"x": 1}), ["flags keys must use allowed issue flags", "hosts value must be a bounded non-negative integer", "hosts key must be an allowed retained host"]),
    ("trend", X.changed(D, model_eras=[]), ["model_eras must be an object"]),
    ("trend", X.changed(D, flags={FLAG[1] + "x" * 60: 1}), ["flags key must be a safe token", "flags keys must use allowed issue flags"]),
    ("trend", window(end=X.at("00:00:00.000000001", X.NEXT)), ["window duration must match window.mode"]),
    ("trend", window(start=X.at("00:00:00", X.LATER)), ["window.start must be before window.end"]),
    ("trend", window(start="yesterday", mode="monthly", more=1), ["unexpected field is not allowed", "window.mode must be an allowed retained mode", "window.start must be timestamp"]),
    ("trend", window(mode="weekly", start=X.at("00:00:00", X.WEEK_BEFORE)), []),
    ("trend", X.changed(D, window=3), ["window must be an object"]),
    ("trend", X.changed(D, coverage_gaps=[{"host": "scope", "reason": "unreachable", "bytes": 3}, {"host": "x", "root_ref": "y", "bytes": -1}, 5]), [
        "coverage_gaps[2]: coverage gap host must be an allowed retained host", "coverage_gaps[2]: coverage gap reason is invalid", "coverage_gaps[2]: coverage gap root_ref must be path_ref_v1",
        "coverage_gaps[2]: coverage gap bytes must be a non-negative integer", "coverage_gaps[3]: coverage gap must be an object",
    ]),
    ("trend", X.changed(D, coverage_gaps=[{"host": "scope", "reason": "unreachable"}] * 101), ["coverage_gaps must contain at most 100 items"]),
    ("manifest", M, []),
    ("manifest", X.changed(M, mode="weekly"), ["manifest mode must match window.mode"]),
    ("manifest", X.changed(M, retention_safe=1, retention_note="x", redaction_policy_version=1.0), ["manifest redaction_policy_version must be 1", "manifest retention_note is invalid", "manifest retention_safe must be true"]),
    ("manifest", X.changed(M, sources=[]), ["manifest sources must be a non-empty array"]),
    ("manifest", X.changed(M, sources=M["sources"] * 17), ["manifest sources must contain at most 16 items"]),
    ("manifest", source(summary_count=0), ["sources[1]: ready source must have rollout_count or summary_count"]),
    ("manifest", source(status="stale"), ["sources[1]: non-ready source counts must be zero"]),
    ("manifest", source(status="empty", summary_count=0), []),
    ("manifest", source(host="scope", root_ref="/", status=["ready"], summary_count=None), [
        "sources[1]: source host must be an allowed retained host", "sources[1]: source root_ref must be path_ref_v1", "sources[1]: source status is invalid",
        "sources[1]: source summary_count must be a bounded non-negative integer",
    ]),
    ("manifest", X.changed(M, retention_note=URL), ["manifest retained text contains raw/sensitive evidence", "manifest retention_note is invalid"]),
]


def test_row_rules(spark):
    records = [(k, json.dumps(r)) for k, r, _ in CASES] + [("episode", '{"a":1,"a":2}'), ("episode", '{"a":1} x'), ("trend", "NaN")]
    got: dict = {}
    for x in record_issues(spark.createDataFrame(records, "kind string, json string")).collect():
        got.setdefault((x.kind, x.json), []).append(x.message)
    for kind, record, want in CASES:
        assert sorted(got.get((kind, json.dumps(record)), [])) == sorted(want), record
    assert [got[r] for r in records[-3:]] == [["not strict JSON"]] * 3


def test_streamed_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"kind": k, "json": json.dumps(r)}) for k, r, _ in CASES[:4]))
    stream = record_issues(spark.readStream.schema("kind string, json string").json(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("found").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(120)
    assert sorted(x.message for x in spark.table("found").collect()) == sorted(m for _, _, w in CASES[:4] for m in w)


RISKY = {
    "private_key": [KEY], "url": [URL, "SSH" + "://x"], "git_remote": ["git" + "@host:x"], "email": [MAIL], "posix_path": ["in /ho" + "me/x", "~" + "/x"], "tool_state": ["./.co" + "dex/x"],
    "sessions": ["archived_" + "sessions/x"], "windows_path": ["C:" + "\\Users\\x"], "secret_assignment": ["my_pass" + "word = x", "API" + " key: y"], "bearer": ["Bear" + "er abcdefgh1234567"],
    "api_key": ["sk" + "-proj-abcdefghijklmnopqrst"], "bare_token": ["gh" + "p_" + "a" * 20], "hex64": ["f" * 64], "uuid": ["01234567-89ab-cdef-0123-456789abcdef"], "rollout_name": ["rollout" + "-x.jsonl"],
    "private_ipv4": ["at 10.1" + ".2.3", "192.168" + ".0.1"], "private_ipv6": ["fe80" + "::1", "x ::1"], "raw_id_value": ["session" + " id: abcdef1"], "raw_id_token": ["turn" + "_id_abcdef1"],
    "reserved_domain": ["db.prod" + ".internal", "a.-.-" + ".local"], "safety_words": ["the secret", "客户", "reset" + " --hard"],
}
SAFE = ["plain words", "11.1.2.3", "110.1.2.3.4", "f" * 63, "session_ref_v1 only", "not an at sign", "a.localx", "tokens of thanks", "path/home"]


def test_patterns(spark):
    rows = [(n, s) for n, each in RISKY.items() for s in each]
    df = spark.createDataFrame(rows, "name string, text string")
    own = F.lit(False)
    for n in RISKY:
        own = own | ((F.col("name") == n) & text.hits(F.col("text"), [n]))
    assert df.filter(~own).collect() == []
    assert df.filter(~text.risky_text(F.col("text"))).collect() == []
    assert spark.createDataFrame([(s,) for s in SAFE], "text string").filter(text.risky_text(F.col("text"))).collect() == []
    long = spark.createDataFrame([("a." * 6_000,), ("-" * 6_000,), ("'" * 6_000,)], "text string")
    assert long.filter(text.risky_text(F.col("text"))).count() == 0


def test_times_paths_and_json(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    for ts, ok in (("2024-02-29T00:00:00Z", True), ("2023-02-29T00:00:00Z", False), ("0000-01-01T00:00:00Z", False), ("2026-01-01T00:00:00Z\n", False), ("2026-01-01T24:00:00Z", False), ("2026-01-01T00:00:00.1234567890Z", False), ("1900-02-29T00:00:00Z", False)):
        assert one(times.valid(F.lit(ts)))[0] == ok, ts
    assert one(times.key(F.lit("2026-01-01T00:00:00.5Z")))[0] == "2026-01-01T00:00:00.500000000"
    parts = lambda p: F.split(F.lit(p), "/")
    for p, kind, bad in (("retained/daily/episodes.jsonl", "episode", False), ("data/trends/2026/05/trend_report.json", "trend", False), ("data/trends/9999/12/trend_report.json", None, False), ("a/RAW/x.md", None, True), ("x/userPrompt.txt", None, True), ("x/history.json.gz", None, True), ("Rollout.txt", None, True), ("notes/ok.md", None, False)):
        assert one(paths.kind(parts(p)), paths.forbidden(parts(p)))[:] == (kind, bad), p
    assert one(paths.baseline_report(F.lit("2026-02-21_to_2026-05-22.md")), paths.baseline_report(F.lit("2026-02-22_to_2026-05-22.md")))[:] == (True, False)
    json_text = F.lit('{"a":{"b\\u002fc":["x: y","q\\"z",{"d":1}]},"e":"v"}')
    assert one(F.sort_array(jsonv.deep_keys(json_text)), F.sort_array(jsonv.deep_strings(json_text)))[:] == (["a", "b/c", "d", "e"], ['q"z', "v", "x: y"])
    assert one(text.infrastructure_risk(F.lit("  'auth.json',\nsessions/\nfine")), text.infrastructure_risk(F.lit("x\nsee sess" + "ions/a")))[:] == (False, True)
