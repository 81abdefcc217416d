"""Registered queries that hold made-up records against the row rules, with SQL that judges the records' columns by itself.

A record's columns are expressions over a table's key, written once for both engines. The library gets them as JSON texts and answers with messages; the
SQL never sees a JSON text of a whole record: it takes the same columns and says what is wrong with them in its own way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import fixed, jsonv, paths, text, times
from sluice.plans import rules


class Made:
    """Columns over the key of a table, as expressions of either engine."""

    def __init__(self, table: str, key: str, duck: bool):
        self.table, self.key, self.duck, self.columns = table, key, duck, {}

    def md5(self, x: str, n: int | str) -> str:
        return f"substr(md5(CAST({x} AS VARCHAR)), 1, {n})" if self.duck else f"substr(md5(CAST(CAST({x} AS STRING) AS BINARY)), 1, {n})"

    def time(self, minutes: str) -> str:
        if self.duck:
            return f"strftime(TIMESTAMP '2031-02-27 22:00:00' + to_minutes(CAST({minutes} AS BIGINT)), '%Y-%m-%dT%H:%M:%S')"
        return f"date_format(TIMESTAMP_NTZ'2031-02-27 22:00:00' + make_dt_interval(0, 0, CAST({minutes} AS INT), 0), \"yyyy-MM-dd'T'HH:mm:ss\")"

    def pick(self, *values: str, by: str = "") -> str:
        """One of the expressions, in turn; by: what the key is divided by first."""
        k = f"(({self.key} // {by}) % {len(values)})" if by and self.duck else f"(({self.key} DIV {by}) % {len(values)})" if by else f"({self.key} % {len(values)})"
        return f"CASE {k} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

    def every(self, n: int, then: str, otherwise: str) -> str:
        return f"CASE WHEN {self.key} % {n} = 0 THEN {then} ELSE {otherwise} END"

    def sql(self) -> str:
        return f"SELECT {self.key} AS id, " + ", ".join(f"{e} AS {c}" for c, e in self.columns.items()) + f" FROM {self.table}"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The keys are dealt out first: they are few bytes for much work, and a file of millions of them may be one task's."""
        keys = spark.read.parquet(f"{sf_dir}/{self.table}.parquet").select(self.key).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return keys.selectExpr(f"{self.key} AS id", *(f"{e} AS {c}" for c, e in self.columns.items()))


def lit(x: str) -> str:
    return f"'{x}'"


def listed(values: list[str]) -> str:
    return ", ".join(map(lit, values))


def quoted(column: str) -> str:
    return f"coalesce('\"' || {column} || '\"', 'null')"


def json_of(fields: dict[str, str], more: str = "''") -> Column:
    """A JSON object of fields and the expressions of their JSON texts, those that are null left out, and more text before its end."""
    parts = ", ".join(f"'\"{name}\":' || {e}" for name, e in fields.items())
    return F.expr(f"'{{' || concat_ws(',', {parts}) || {more} || '}}'")


def said(frame: DataFrame, kind: str, folder: Column | None = None) -> DataFrame:
    """(id, message) of records (id, json)."""
    parsed = frame.withColumn("doc", jsonv.strict(F.col("json")))
    deep = parsed.withColumn("keys", jsonv.deep_keys(F.col("json"))).withColumn("strings", jsonv.deep_strings(F.col("json")))
    if kind in ("episode", "turn_flag"):
        found = rules.row_issues(F.lit(kind), F.col("doc"), F.col("keys"))
    else:
        found = rules.document_issues(F.lit(kind), F.col("doc"), F.col("keys"), F.col("strings"), folder if folder is not None else F.lit(None).cast("string"))
    return deep.select("id", F.explode(found).alias("message"))


def verdicts(made: str, cases: dict[str, str], more: list[str] = ()) -> str:
    """SQL of (id, message): a message for each case that holds."""
    each = ", ".join(f"CASE WHEN {cond} THEN '{message}' END" for message, cond in cases.items())
    union = "".join(f" UNION ALL {m}" for m in more)
    return f"WITH made AS ({made}) SELECT * FROM (SELECT id, unnest([{each}]) AS message FROM made{union}) WHERE message IS NOT NULL"


# --- what the SQL thinks of single values ---------------------------------------------------------------------------------------
def sql_ref(c: str, prefix: str, n: int) -> str:
    return f"NOT coalesce(regexp_full_match({c}, '{prefix}:[0-9a-f]{{{n}}}'), FALSE)"


def sql_in(c: str, values: list[str]) -> str:
    return f"coalesce({c} NOT IN ({listed(values)}), TRUE)"


def sql_time(c: str) -> str:
    """Whether a text is a timestamp."""
    return f"coalesce(regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3])(:[0-5][0-9]){{2}}([.][0-9]{{1,9}})?Z') AND TRY_CAST(substr({c}, 1, 10) AS DATE) IS NOT NULL, FALSE)"


def sql_nanos(c: str) -> str:
    """Nanoseconds since 1970 of a good timestamp."""
    return f"CASE WHEN {sql_time(c)} THEN epoch_us(CAST(substr({c}, 1, 19) AS TIMESTAMP)) * 1000 + CAST(rpad(regexp_extract({c}, '[.]([0-9]+)Z', 1), 9, '0') AS BIGINT) END"


def sql_count(c: str) -> str:
    """Whether a JSON text is no bounded count."""
    return f"NOT (regexp_full_match({c}, '[0-9]{{1,12}}') AND coalesce(TRY_CAST({c} AS BIGINT), -1) BETWEEN 0 AND 1000000)"


def sql_risk(c: str) -> str:
    """The patterns of retained text that the made-up texts can have."""
    return f"(length({c}) > 1200 OR regexp_matches({c}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}|(?i)https?://|\\bpassword\\b|\\b[a-z0-9-]+\\.internal\\b'))"


def sql_flags(c: str, name: str, least: int) -> dict[str, str]:
    allowed, dup = f"list_transform({c}, lambda x: x IN ({listed(fixed.ISSUE_FLAGS)}))", f"list_transform(range(1, len({c}) + 1), lambda i: list_position({c}, {c}[i]) < i)"
    odd, twice = f"coalesce(list_position({allowed}, FALSE), 0)", f"coalesce(list_position({dup}, TRUE), 0)"
    unsafe = f"len(list_filter({c}, lambda x: NOT regexp_full_match(x, '[A-Za-z0-9_.-]{{1,64}}'))) > 0"
    out = {
        f"{name} must be safe-token array": f"{c} IS NULL OR {unsafe}",
        f"{name} must contain at most 16 items": f"len({c}) > 16",
        f"{name} must use allowed issue flags": f"{odd} > 0 AND ({twice} = 0 OR {odd} <= {twice})",
        f"{name} must not contain duplicate issue flags": f"{twice} > 0 AND ({odd} = 0 OR {twice} < {odd})",
    }
    return out | ({f"{name} must contain at least 1 item": f"len({c}) < 1"} if least else {})


TEXTS = ["'plain words'", "repeat('long ', 241)", "'mail to a@b.org'", "'see HTTPS://x'", "'my password here'", "'on db.internal now'", "'tokens of thanks'", "NULL"]
COUNTS = ["'0'", "'7'", "'1000000'", "'1000001'", "'-1'", "'1.0'", "'true'", "'\"3\"'", "'null'"]
FLAG_LISTS = [
    [], fixed.ISSUE_FLAGS[:1], fixed.ISSUE_FLAGS[:3], [fixed.ISSUE_FLAGS[4]] * 2, ["zzz"], [fixed.ISSUE_FLAGS[2], "zzz", "zzz"], [fixed.ISSUE_FLAGS[2]] * 2 + ["zzz"], [fixed.ISSUE_FLAGS[5]] * 17, ["a b"],
    None,
]


def _flag_columns(m: Made, by: str) -> None:
    if m.duck:
        m.columns["flags"] = m.pick(*("NULL" if x is None else f"CAST([{listed(x)}] AS VARCHAR[])" for x in FLAG_LISTS), by=by)
    else:
        m.columns["flags"] = m.pick(*("'{}'" if x is None else lit("[" + ",".join(f'"{f}"' for f in x) + "]") for x in FLAG_LISTS), by=by)


def _shared(m: Made) -> None:
    k = m.key
    m.columns |= {
        "episode_id": f"'episode_ref_v1:' || {m.md5(k, m.every(7, '19', '20'))}",
        "host": m.pick("'local'", "'custom_source'", "'scope'", "'elsewhere'", "NULL"),
        "session_id": f"'session_ref_v1:' || {m.md5(f'{k} % 9', 20)} || {m.every(13, lit('0'), lit(''))}",
        "cwd": m.pick("NULL", f"'path_ref_v1:' || {m.md5(k, 16)}", "'/x'", by="2"),
        "model_era": m.pick(*map(lit, [fixed.MODEL_ERAS[0], fixed.MODEL_ERAS[-1], "other"]), by="4"),
    }
    _flag_columns(m, "3")


def _stamp(m: Made, minutes: str, odd: int) -> str:
    """A timestamp, now and then a day or an hour that isn't, with too many digits, or null."""
    t = m.time(minutes)
    return f"CASE WHEN {m.key} % {odd} = 0 THEN NULL WHEN {m.key} % {odd} = 1 THEN '2031-02-29T00:00:00Z' WHEN {m.key} % {odd} = 2 THEN substr({t}, 1, 11) || '24:00:00Z' WHEN {m.key} % {odd} = 3 THEN {t} || '.0000000001Z' WHEN {m.key} % {odd} = 4 THEN {t} || '.000000001Z' ELSE {t} || 'Z' END"


def _episodes(duck: bool) -> Made:
    m = Made("customer", "c_custkey", duck)
    _shared(m)
    m.columns |= {
        "start_at": _stamp(m, "c_custkey * 7", 17), "end_at": _stamp(m, "c_custkey * 7 + c_custkey % 5 - 1", 19), "topic": m.pick(*TEXTS), "turns": m.pick(*COUNTS, by="5"),
        "outcome": m.pick("'needs_review'", "'no_issue_observed'", "'fine'", by="3"), "hint": m.pick(*TEXTS, by="8"),
        "extra": f"CASE WHEN c_custkey % 29 = 0 THEN 'path' WHEN c_custkey % 29 = 1 THEN 'notes' WHEN c_custkey % 29 = 2 THEN 'my.token' END", "gone": "c_custkey % 31 = 0",
    }
    return m


EXTRA = """coalesce(',"' || extra || '":[{"deep":1}]', '')"""


def episode_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with made-up episodes, one a customer."""
    fields = {c: quoted(c) for c in ("episode_id", "host", "session_id", "cwd", "model_era", "outcome")}
    fields |= {"start": quoted("start_at"), "end": quoted("end_at"), "topic": f"CASE WHEN NOT gone THEN {quoted('topic')} END", "work_report_hint": quoted("hint"), "turn_count": "turns", "friction_flags": "flags"}
    return said(_episodes(False).frame(spark, sf_dir).select("id", json_of(fields, EXTRA).alias("json")), "episode")


def _shared_cases() -> dict[str, str]:
    return {
        "unexpected field is not allowed": "extra IS NOT NULL",
        "episode_id must be episode_ref_v1": sql_ref("episode_id", "episode_ref_v1", 20),
        "host must be an allowed retained host": sql_in("host", fixed.EVIDENCE_HOSTS),
        "session_id must be session_ref_v1": sql_ref("session_id", "session_ref_v1", 20),
        "cwd must be path_ref_v1 or null": f"cwd IS NOT NULL AND {sql_ref('cwd', 'path_ref_v1', 16)}",
        "model_era must be an allowed retained model era": sql_in("model_era", fixed.MODEL_ERAS),
    }


EPISODE_SQL = verdicts(_episodes(True).sql(), _shared_cases() | {
    "episode contains raw root/path field": "extra = 'path'",
    "episode JSON key contains raw/sensitive evidence": "extra = 'my.token'",
    "missing required field: topic": "gone",
    "start must be timestamp or null": f"start_at IS NOT NULL AND NOT {sql_time('start_at')}",
    "end must be timestamp or null": f"end_at IS NOT NULL AND NOT {sql_time('end_at')}",
    "episode start must be before or equal to end": f"coalesce(({sql_nanos('start_at')}) > ({sql_nanos('end_at')}), FALSE)",
    "topic must be retained text": "gone OR topic IS NULL",
    "topic contains retained-text risk": f"NOT gone AND coalesce({sql_risk('topic')}, FALSE)",
    "turn_count must be a bounded non-negative integer": sql_count("turns"),
    "outcome is invalid": sql_in("outcome", fixed.OUTCOMES),
    "work_report_hint contains retained-text risk": f"coalesce({sql_risk('hint')}, FALSE)",
} | sql_flags("flags", "friction_flags", 0))


def _turns(duck: bool) -> Made:
    m = Made("supplier", "s_suppkey", duck)
    _shared(m)
    m.columns |= {
        "turn_id": f"'turn_ref_v1:' || {m.md5('s_suppkey', m.every(5, '21', '20'))}", "source_path": m.every(6, "'raw/x'", f"'path_ref_v1:' || {m.md5('s_suppkey', 16)}"),
        "source_hash": m.every(8, "NULL", f"'source_hash_v1:' || {m.md5('s_suppkey', 20)}"), "stamp": _stamp(m, "s_suppkey", 11), "model": m.pick("NULL", lit(fixed.MODEL_IDS[1]), "'unknown'"),
        "asked": m.pick(*TEXTS), "did": m.pick(*TEXTS, by="3"), "better": m.pick(*TEXTS, by="5"), "extra": m.every(10, "'root'", "NULL"),
    }
    return m


def turn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with made-up turns, one a supplier."""
    fields = {c: quoted(c) for c in ("turn_id", "episode_id", "host", "session_id", "source_path", "source_hash", "cwd", "model", "model_era")}
    fields |= {"timestamp": quoted("stamp"), "redacted_user_prompt_summary": quoted("asked"), "assistant_action_summary": quoted("did"), "prompt_improvement": quoted("better"), "issue_flags": "flags"}
    return said(_turns(False).frame(spark, sf_dir).select("id", json_of(fields, EXTRA).alias("json")), "turn_flag")


TURN_SQL = verdicts(_turns(True).sql(), _shared_cases() | {
    "turn flag contains raw root/path field": "extra = 'root'",
    "turn_id must be turn_ref_v1": sql_ref("turn_id", "turn_ref_v1", 20),
    "source_path must be path_ref_v1": sql_ref("source_path", "path_ref_v1", 16),
    "source_hash must be source_hash_v1": sql_ref("source_hash", "source_hash_v1", 20),
    "timestamp must be timestamp or null": f"stamp IS NOT NULL AND NOT {sql_time('stamp')}",
    "model must be an allowed retained model id or null": f"model IS NOT NULL AND {sql_in('model', fixed.MODEL_IDS)}",
    "redacted_user_prompt_summary must be retained text": "asked IS NULL",
    "redacted_user_prompt_summary contains retained-text risk": f"coalesce({sql_risk('asked')}, FALSE)",
    "assistant_action_summary must be retained text": "did IS NULL",
    "assistant_action_summary contains retained-text risk": f"coalesce({sql_risk('did')}, FALSE)",
    "prompt_improvement contains retained-text risk": f"coalesce({sql_risk('better')}, FALSE)",
} | sql_flags("flags", "issue_flags", 1))


# --- documents: windows, maps, gaps and sources -----------------------------------------------------------------------------------
MAPS = ["{}", '{"local":1,"verification_gap":2,"unknown":3}', '{"scope":1}', '{"local":1.0,"context_loss":-1}', "[]", '{"a b":1}', '{"gpt-5.5":1000001,"under_asking":0}', "null"]
GAPS = [
    "[]", '[{"host":"scope","reason":"unreachable"}]', '[{"host":"x","reason":"unreachable","bytes":-1},{"host":"local","reason":"stale_host","bytes":5}]', "[5]", "null",
    '[{"host":"local","reason":"nope","root_ref":"y","more":1}]', '[{"reason":"auth_gated","root_ref":"path_ref_v1:0123456789abcdef"}]',
]
SOURCE_LISTS = [
    '[{"host":"local","root_ref":"path_ref_v1:0123456789abcdef","status":"ready","rollout_count":1,"summary_count":0}]',
    '[{"host":"local","root_ref":"path_ref_v1:0123456789abcdef","status":"ready","rollout_count":0,"summary_count":0}]', "[]", "{}",
    '[{"host":"scope","root_ref":"x","status":"gone","rollout_count":-1,"summary_count":null}]', '[{"host":"custom_source","root_ref":"path_ref_v1:0123456789abcdef","status":"stale","rollout_count":0,"summary_count":2}]',
    '[7,{"host":"local","status":"empty","rollout_count":0,"summary_count":0,"z":1}]', "[" + ",".join(['{"host":"local","root_ref":"path_ref_v1:0123456789abcdef","status":"empty","rollout_count":0,"summary_count":0}'] * 17) + "]",
]


def _windows(m: Made) -> None:
    k = m.key
    days = m.pick("1", "7", "90", "2", by="3")
    m.columns |= {
        "mode": m.pick("'daily'", "'weekly'", "'baseline-90d'", "'monthly'", "NULL"),
        "w_start": f"{m.time(f'{k} % 7')} || {m.every(17, lit('x'), lit('Z'))}",
        "w_end": f"CASE WHEN {k} % 23 = 0 THEN {m.time(f'{k} % 7 - 1')} || 'Z' ELSE {m.time(f'{k} % 7 + 1440 * ({days})')} || {m.every(6, lit('.000000001Z'), lit('Z'))} END",
        "folder": m.pick("NULL", "'daily'", "'weekly'", "'baseline'", by="5"),
        "gaps": m.pick(*map(lit, GAPS), by="2"), "version": m.pick("'1'", "'1'", "'2'", "'true'", "'1.0'", "'null'"),
    }


WINDOW = """'{"mode":' || coalesce('"' || mode || '"', 'null') || ',"start":"' || w_start || '","end":"' || w_end || '"}'"""


def _window_cases(label: str) -> dict[str, str]:
    a, b = f"({sql_nanos('w_start')})", f"({sql_nanos('w_end')})"
    days = "CASE mode WHEN 'daily' THEN 1 WHEN 'weekly' THEN 7 WHEN 'baseline-90d' THEN 90 END"
    wrong = {d: f"folder = '{d}' AND mode IS DISTINCT FROM '{'baseline-90d' if d == 'baseline' else d}'" for d in fixed.EXPORT_DIRS}
    return {
        "window.mode must be an allowed retained mode": sql_in("mode", list(fixed.MODE_DAYS)),
        "window.start must be timestamp": f"{a} IS NULL",
        "window.end must be timestamp": f"{b} IS NULL",
        "window.start must be before window.end": f"coalesce({a} >= {b}, FALSE)",
        "window duration must match window.mode": f"coalesce({a} < {b} AND {b} - {a} <> {days} * 86400000000000, FALSE)",
    } | {f"{label} must match retained/{d} export directory": cond for d, cond in wrong.items()}


def _elements(column: str, cases: dict[str, str], prefix: str) -> str:
    """(id, message) of a JSON array's elements x, numbered from 1, whose cases hold."""
    each = ", ".join(f"CASE WHEN {cond} THEN '{message}' END" for message, cond in cases.items())
    return (
        f"SELECT id, '{prefix}[' || i || ']: ' || m FROM (SELECT id, i, unnest([{each}]) AS m FROM (SELECT id, i, json_extract(j, '$[' || (i - 1) || ']') AS x FROM "
        f"(SELECT id, CAST({column} AS JSON) AS j, unnest(range(1, CASE WHEN json_type({column}) = 'ARRAY' THEN CAST(json_array_length({column}) AS BIGINT) ELSE 0 END + 1)) AS i FROM made))) WHERE m IS NOT NULL"
    )


def _is(x: str) -> str:
    return f"json_type({x}) = 'OBJECT'"


def _member(name: str) -> str:
    return f"json_extract_string(x, '$.{name}')"


def _not_count(name: str) -> str:
    """A member is no bounded count; one that is missing neither."""
    value = f"json_extract(x, '$.{name}')"
    return f"NOT coalesce(json_type({value}) IN ('UBIGINT', 'BIGINT') AND CAST({value} AS BIGINT) BETWEEN 0 AND 1000000, FALSE)"


def _closed(keys: list[str]) -> str:
    return f"len(list_filter(json_keys(x), lambda k: k NOT IN ({listed(keys)}))) > 0"


GAP_SQL = _elements("gaps", {
    "coverage gap must be an object": f"NOT {_is('x')}",
    "unexpected field is not allowed": f"{_is('x')} AND {_closed(fixed.GAP_KEYS)}",
    "coverage gap host must be an allowed retained host": f"{_is('x')} AND {sql_in(_member('host'), fixed.COVERAGE_HOSTS)}",
    "coverage gap reason is invalid": f"{_is('x')} AND {sql_in(_member('reason'), fixed.COVERAGE_REASONS)}",
    "coverage gap root_ref must be path_ref_v1": f"{_is('x')} AND json_exists(x, '$.root_ref') AND {sql_ref(_member('root_ref'), 'path_ref_v1', 16)}",
    "coverage gap bytes must be a non-negative integer": f"{_is('x')} AND json_exists(x, '$.bytes') AND {_not_count('bytes')}",
}, "coverage_gaps")

SOURCE_SQL = _elements("sources", {
    "source summary must be an object": f"NOT {_is('x')}",
    "unexpected field is not allowed": f"{_is('x')} AND {_closed(fixed.SOURCE_KEYS)}",
    "missing required field: root_ref": f"{_is('x')} AND NOT json_exists(x, '$.root_ref')",
    "source host must be an allowed retained host": f"{_is('x')} AND {sql_in(_member('host'), fixed.EVIDENCE_HOSTS)}",
    "source root_ref must be path_ref_v1": f"{_is('x')} AND {sql_ref(_member('root_ref'), 'path_ref_v1', 16)}",
    "source status is invalid": f"{_is('x')} AND {sql_in(_member('status'), fixed.SOURCE_STATUSES)}",
    "source rollout_count must be a bounded non-negative integer": f"{_is('x')} AND {_not_count('rollout_count')}",
    "source summary_count must be a bounded non-negative integer": f"{_is('x')} AND {_not_count('summary_count')}",
    "ready source must have rollout_count or summary_count": f"{_is('x')} AND {_member('status')} = 'ready' AND CAST({_member('rollout_count')} AS BIGINT) + CAST({_member('summary_count')} AS BIGINT) = 0",
    "non-ready source counts must be zero": f"{_is('x')} AND {_member('status')} IN ('empty', 'missing', 'stale') AND ({_member('rollout_count')} <> '0' OR {_member('summary_count')} <> '0')",
}, "sources")


def _map_sql(column: str, name: str, domain: list[str], message: str, once: bool) -> list[str]:
    j = f"CAST({column} AS JSON)"
    entry = f"SELECT id, k, json_extract(j, '$.\"' || k || '\"') AS v FROM (SELECT id, {j} AS j, unnest(CASE WHEN json_type({column}) = 'OBJECT' THEN json_keys({j}) ELSE [] END) AS k FROM made)"
    odd = f"k NOT IN ({listed(domain)})"
    count = "coalesce(json_type(v) IN ('UBIGINT', 'BIGINT') AND CAST(v AS BIGINT) BETWEEN 0 AND 1000000, FALSE)"
    return [
        f"SELECT id, '{name} must be an object' FROM made WHERE json_type({column}) <> 'OBJECT'",
        f"SELECT id, '{name} key must be a safe token' FROM ({entry}) WHERE NOT regexp_full_match(k, '[A-Za-z0-9_.-]{{1,64}}')",
        f"SELECT id, '{name} value must be a bounded non-negative integer' FROM ({entry}) WHERE NOT {count}",
        f"SELECT {'DISTINCT ' * once}id, '{message}' FROM ({entry}) WHERE {odd}",
    ]


def _trends(duck: bool) -> Made:
    m = Made("supplier", "s_suppkey", duck)
    _windows(m)
    m.columns |= {
        "turns": m.pick(*COUNTS, by="2"), "flagged": m.pick(*COUNTS, by="3"), "episodes": m.pick(*COUNTS), "flags": m.pick(*map(lit, MAPS)), "hosts": m.pick(*map(lit, MAPS), by="3"),
        "eras": m.pick(*map(lit, MAPS), by="7"), "gone": "s_suppkey % 21 = 0",
    }
    return m


def trend_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with made-up trend reports, one a supplier."""
    fields = {"schema_version": "version", "window": WINDOW, "turn_count": "turns", "flagged_turn_count": "flagged", "episode_count": "CASE WHEN NOT gone THEN episodes END", "flags": "flags", "hosts": "hosts", "model_eras": "eras", "coverage_gaps": "gaps"}
    made = _trends(False).frame(spark, sf_dir)
    return said(made.select("id", "folder", json_of(fields).alias("json")), "trend", F.col("folder"))


TREND_SQL = verdicts(_trends(True).sql(), _window_cases("trend window.mode") | {
    "trend schema_version must be 1": "version <> '1'",
    "missing required field: episode_count": "gone",
    "turn_count must be a non-negative integer": sql_count("turns"),
    "flagged_turn_count must be a non-negative integer": sql_count("flagged"),
    "episode_count must be a non-negative integer": f"gone OR {sql_count('episodes')}",
    "flagged_turn_count must be less than or equal to turn_count": f"NOT {sql_count('turns')} AND NOT {sql_count('flagged')} AND TRY_CAST(flagged AS BIGINT) > TRY_CAST(turns AS BIGINT)",
    "coverage_gaps must be an array": "json_type(gaps) <> 'ARRAY'",
}, [
    GAP_SQL, *_map_sql("flags", "flags", fixed.ISSUE_FLAGS, "flags keys must use allowed issue flags", True), *_map_sql("hosts", "hosts", fixed.EVIDENCE_HOSTS, "hosts key must be an allowed retained host", False),
    *_map_sql("eras", "model_eras", fixed.MODEL_ERAS, "model_eras key must be an allowed retained model era", False),
])


def _manifests(duck: bool) -> Made:
    m = Made("supplier", "s_suppkey", duck)
    _windows(m)
    m.columns |= {
        "own_mode": m.every(4, "'daily'", m.columns["mode"]), "sources": m.pick(*map(lit, SOURCE_LISTS)), "policy": m.pick("'1'", "'1.0'", "'1'", "'false'", by="3"),
        "note": m.pick(lit(fixed.RETENTION_NOTE), "'kept at db.internal'", lit(fixed.RETENTION_NOTE), "'other'", by="2"), "safe": m.pick("'true'", "'false'", "'1'", "'true'", by="6"),
    }
    return m


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with made-up manifests, one a supplier."""
    fields = {"schema_version": "version", "mode": quoted("own_mode"), "window": WINDOW, "sources": "sources", "coverage_gaps": "gaps", "redaction_policy_version": "policy", "retention_note": quoted("note"), "retention_safe": "safe"}
    return said(_manifests(False).frame(spark, sf_dir).select("id", "folder", json_of(fields).alias("json")), "manifest", F.col("folder"))


_MANIFEST_CASES = _window_cases("manifest mode")
_MANIFEST_CASES = {m: c.replace("AND mode IS DISTINCT", "AND own_mode IS DISTINCT") for m, c in _MANIFEST_CASES.items()}
MANIFEST_SQL = verdicts(_manifests(True).sql(), _MANIFEST_CASES | {
    "manifest retained text contains raw/sensitive evidence": sql_risk("note"),
    "manifest schema_version must be 1": "version <> '1'",
    "manifest mode must be an allowed retained mode": sql_in("own_mode", list(fixed.MODE_DAYS)),
    "manifest mode must match window.mode": "own_mode IS DISTINCT FROM mode",
    "manifest sources must be a non-empty array": "json_type(sources) <> 'ARRAY' OR json_array_length(sources) = 0",
    "manifest sources must contain at most 16 items": "json_type(sources) = 'ARRAY' AND json_array_length(sources) > 16",
    "coverage_gaps must be an array": "json_type(gaps) <> 'ARRAY'",
    "manifest redaction_policy_version must be 1": "policy <> '1'",
    "manifest retention_note is invalid": f"note <> '{fixed.RETENTION_NOTE}'",
    "manifest retention_safe must be true": "safe <> 'true'",
}, [GAP_SQL, SOURCE_SQL])


# --- windows, tokens, lines, reports ------------------------------------------------------------------------------------------------
def window_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of valid windows, to compare windows by; null for others."""
    made = _trends(False).frame(spark, sf_dir).withColumn("doc", jsonv.strict(F.concat(F.lit('{"window":'), F.expr(WINDOW), F.lit("}"))))
    return made.select("id", rules.window_identity(F.col("doc")).alias("w")).select("id", F.col("w.mode").alias("mode"), F.col("w.start").alias("from_key"), F.col("w.end").alias("to_key"))


_KEY = "substr({0}, 1, 19) || '.' || rpad(regexp_extract({0}, '[.]([0-9]+)Z', 1), 9, '0')"
_GOOD = f"NOT {sql_in('mode', list(fixed.MODE_DAYS))} AND {sql_time('w_start')} AND {sql_time('w_end')}"
WINDOW_SQL = f"""WITH made AS ({_trends(True).sql()})
SELECT id, CASE WHEN {_GOOD} THEN mode END AS mode, CASE WHEN {_GOOD} THEN {_KEY.format('w_start')} END AS from_key, CASE WHEN {_GOOD} THEN {_KEY.format('w_end')} END AS to_key FROM made"""


def _tokens(duck: bool) -> Made:
    m = Made("part", "p_partkey", duck)
    m.columns["token"] = m.pick("'plain_token-1.x'", f"repeat('x', CAST(60 + p_partkey % 9 AS {'BIGINT' if duck else 'INT'}))", "'a b'", "'my.secret'", "'mysecret'", "'x-credentials-y'", "'a@b.org'", "''", "'api_key'", "'db.internal'", f"{m.md5('p_partkey', 32)}", "NULL")
    return m


def safe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether made-up words are safe tokens, and whether they speak of secrets."""
    return _tokens(False).frame(spark, sf_dir).select("id", text.safe_token(F.col("token")).alias("safe"), text.risky_token(F.col("token")).alias("risky"))


_RISKY = "coalesce(regexp_matches(token, '(?i)(^|[._-])(password|passwd|pwd|credentials?|secret|token|api[._-]?key|authorization|private[._-]?key)($|[._-])'), FALSE)"
TOKEN_SQL = f"WITH made AS ({_tokens(True).sql()}) SELECT id, coalesce(regexp_full_match(token, '[A-Za-z0-9_.-]{{1,64}}') AND NOT {_RISKY} AND NOT {sql_risk('token')}, FALSE) AS safe, {_RISKY} AS risky FROM made"


def _lines(duck: bool) -> Made:
    m = Made("part", "p_partkey", duck)
    nl = "chr(10)"
    m.columns["body"] = m.pick("'fine'", f"'sessions/' || {nl} || 'fine'", f"'x' || {nl} || 'in sessions/a'", f"'  \"auth.json\",' || {nl}", "'see https://localhost/x'", "'see https://there.org/x'", "'mail a@b.org'", "'tokens = 3'", "'mytoken = 3'", "''", "NULL")
    return m


def infrastructure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a made-up text has a line that must not be in the repository's own files."""
    return _lines(False).frame(spark, sf_dir).select("id", text.infrastructure_risk(F.col("body")).alias("risk"))


_LINE = "regexp_matches(l, '(?i)https?://localhost|[a-z0-9.]+@[a-z0-9.]+[.][a-z]{2,}|(^|[^a-z0-9_])sessions/|[a-z]token *=')"
LINE_SQL = f"""WITH made AS ({_lines(True).sql()})
SELECT id, coalesce(len(list_filter(string_split(body, chr(10)), lambda l: trim(rtrim(trim(l), ','), '"') NOT IN ({listed(fixed.SAFE_INFRASTRUCTURE_LINES)}) AND {_LINE})) > 0, FALSE) AS risk FROM made"""


def _reports(duck: bool) -> Made:
    m = Made("part", "p_partkey", duck)
    day = lambda n: f"substr({m.time(f'1440 * ({n})')}, 1, 10)"
    m.columns["name"] = f"CASE WHEN p_partkey % 11 = 0 THEN '2031-02-30_to_2031-05-31.md' WHEN p_partkey % 11 = 1 THEN {day('p_partkey % 400')} || '-' || {day('90')} || '.md' ELSE {day('p_partkey % 400')} || '_to_' || {day('p_partkey % 400 + 88 + p_partkey % 4')} || '.md' END"
    return m


def baseline_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a report's name spans 90 days."""
    return _reports(False).frame(spark, sf_dir).select("id", paths.baseline_report(F.col("name")).alias("valid"))


REPORT_SQL = f"WITH made AS ({_reports(True).sql()}) SELECT id, coalesce(regexp_full_match(name, '.{{10}}_to_.{{10}}[.]md') AND TRY_CAST(substr(name, 15, 10) AS DATE) - TRY_CAST(substr(name, 1, 10) AS DATE) = 90, FALSE) AS valid FROM made"


def _stamps(duck: bool) -> Made:
    m = Made("part", "p_partkey", duck)
    m.columns["stamp"] = _stamp(m, "p_partkey * 37", 13)
    return m


def stamp_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps, days and hours that aren't among them: validity, and the key they are ordered by."""
    return _stamps(False).frame(spark, sf_dir).select("id", times.valid(F.col("stamp")).alias("valid"), times.key(F.col("stamp")).alias("order_key"))


STAMP_SQL = f"WITH made AS ({_stamps(True).sql()}) SELECT id, {sql_time('stamp')} AS valid, CASE WHEN {sql_time('stamp')} THEN {_KEY.format('stamp')} END AS order_key FROM made"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (episode_rows, turn_rows, trend_documents, manifest_documents, window_identities, safe_tokens, infrastructure_lines, baseline_reports, stamp_or_null)
}
ORACLE_SQL: dict[str, str] = {
    "episode_rows": EPISODE_SQL, "turn_rows": TURN_SQL, "trend_documents": TREND_SQL, "manifest_documents": MANIFEST_SQL, "window_identities": WINDOW_SQL, "safe_tokens": TOKEN_SQL,
    "infrastructure_lines": LINE_SQL, "baseline_reports": REPORT_SQL, "stamp_or_null": STAMP_SQL,
}
