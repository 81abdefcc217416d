"""Registered queries: each operator family over the driver's tables, with SQL that gives the same rows.

References are built with md5; clean keys are perturbed by an arithmetic rule where a check would find nothing otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import fixed, jsonv, paths, text, times
from sluice.operators import checks
from sluice.plans import record_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- uniqueness, references, agreement --------------------------------------------------------------------------------------
LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, occurrence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) AS occurrence FROM lineitem) WHERE occurrence > 1""")
def dup_key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of a line's key after the first."""
    return checks.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "occurrence")


@query("SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS o_custkey FROM orders) o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose (perturbed) customer doesn't exist."""
    key = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + 100000000).otherwise(F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("o_custkey"))
    return checks.orphans(orders, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey", "o_custkey")


@query(f"""WITH f AS (SELECT * FROM (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {', '.join(LINE_ORDER)}) AS n FROM lineitem) WHERE n = 1)
SELECT o_orderkey, o_orderstatus, l_partkey, l_quantity FROM orders JOIN f ON l_orderkey = o_orderkey""")
def fk_lookup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their first line: of repeated keys the first wins."""
    first = checks.first_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", *LINE_ORDER])
    return table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "l_partkey", "l_quantity")


@query("""SELECT l_orderkey, l_linenumber, status, status IS DISTINCT FROM o_orderstatus AS status_differs FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linestatus END AS status FROM lineitem)
JOIN orders ON o_orderkey = l_orderkey WHERE status IS DISTINCT FROM o_orderstatus""")
def ref_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose status isn't their order's; null differs from all but null."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linestatus")).alias("status"))
    found = checks.disagreements(rows, table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], {"status": "o_orderstatus"})
    return found.select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "status", "status_differs")


# --- containment ------------------------------------------------------------------------------------------------------------
@query("""SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate OR l_shipdate > o_orderdate + INTERVAL 90 DAY""")
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped outside the 90 days from their order, both ends included."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.filter(checks.outside(F.col("l_shipdate"), F.col("o_orderdate"), F.expr("o_orderdate + INTERVAL 90 DAYS"))).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("""WITH w AS (SELECT CAST(ts AS DATE) AS day, min(ts) AS lo, max(ts) AS hi FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT event_id, day FROM events JOIN w ON CAST(ts AS DATE) = day WHERE ts < lo OR ts >= hi""")
def half_open_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside their day's half-open window from its first to its last click."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    windows = events.filter("event_type = 'click'").groupBy("day").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return events.join(windows, "day").filter(checks.outside(F.col("ts"), F.col("lo"), F.col("hi"), closed=False)).select("event_id", "day")


ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(event_id % 1000000000 AS VARCHAR), 9, '0') || 'Z'"


def _iso(events: DataFrame) -> DataFrame:
    """Events with a timestamp string of nine fraction digits."""
    return events.withColumn("iso", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("event_id") % 1000000000).cast("string"), 9, "0"), F.lit("Z")))


@query("""WITH e AS (SELECT event_id, user_id, ts + to_days(CAST(event_id % 71 AS INT)) AS moved FROM events), m AS (SELECT user_id, date_trunc('month', min(moved)) AS month FROM e GROUP BY 1)
SELECT event_id, strftime(month, '%Y-%m') AS month FROM e JOIN m USING (user_id) WHERE moved < month OR moved >= month + INTERVAL 1 MONTH""")
def month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, moved by up to 70 days, outside the month of their user's first one."""
    moved = table(spark, sf_dir, "events").withColumn("ts", F.expr("ts + make_dt_interval(CAST(event_id % 71 AS INT))"))
    e = moved.select("event_id", "user_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("iso"))
    months = e.groupBy("user_id").agg(F.substring(F.min("iso"), 1, 7).alias("month"))
    begin, end = times.month_bounds(F.substring("month", 1, 4), F.substring("month", 6, 2))
    return e.join(months, "user_id").filter(checks.outside(times.key(F.col("iso")), begin, end, closed=False)).select("event_id", "month")


@query("""WITH w AS (SELECT date_trunc('month', o_orderdate) AS m, CAST(floor(day(o_orderdate) / 7) AS INT) AS week, CAST(min(o_orderdate) - INTERVAL 7 DAY AS DATE) AS lo, CAST(min(o_orderdate) AS DATE) AS hi FROM orders GROUP BY 1, 2)
SELECT CAST(m AS DATE) AS month, week, lo < CAST(m AS DATE) AND hi <= CAST(m + INTERVAL 1 MONTH AS DATE) AS waived FROM w""")
def cross_month_waiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly windows that begin before their month and end within it are excused from its bounds."""
    month = F.trunc(F.to_date("o_orderdate"), "month")
    windows = table(spark, sf_dir, "orders").groupBy(month.alias("month"), F.floor(F.dayofmonth("o_orderdate") / 7).cast("int").alias("week")).agg(F.to_date(F.min("o_orderdate")).alias("hi"))
    lo = F.date_sub("hi", 7)
    return windows.select("month", "week", ((lo < F.col("month")) & (F.col("hi") <= F.add_months("month", 1))).alias("waived"))


# --- limits and reconciliation ------------------------------------------------------------------------------------------------
@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS lim FROM events WHERE event_type <> 'error' GROUP BY 1, 2)
SELECT user_id, day, n, lim FROM d JOIN l USING (user_id, day) WHERE n > lim""")
def cardinality_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-days with more events than events without errors."""
    events = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    limits = events.filter("event_type <> 'error'").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("lim"))
    return checks.above_limit(events, ["user_id", "day"], limits, "lim")


@query("""WITH a AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS key, o_orderkey % 5 AS n FROM orders)
SELECT key, d.n AS declared, a.n AS actual FROM d FULL JOIN a USING (key) WHERE d.n IS DISTINCT FROM a.n""")
def reconcile_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose declared number of lines isn't the counted one."""
    declared = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 5).alias("n"))
    return checks.reconcile(declared, table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n")), ["key"])


@query("""WITH a AS (SELECT l_orderkey AS key, sum(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS key, CAST(floor(o_totalprice / 1000) AS BIGINT) AS n FROM orders)
SELECT key, CAST(d.n AS BIGINT) AS declared, CAST(a.n AS BIGINT) AS actual FROM d FULL JOIN a USING (key) WHERE d.n IS DISTINCT FROM a.n""")
def reconcile_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose declared total isn't the sum of their lines."""
    declared = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.floor(F.col("o_totalprice") / 1000).alias("n"))
    return checks.reconcile(declared, table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n")), ["key"])


@query("""WITH a AS (SELECT user_id % 10 AS host, event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1, 2 HAVING sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) <> 0),
d AS (SELECT user_id % 10 AS host, event_type, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY 1, 2)
SELECT host, event_type, CAST(d.n AS BIGINT) AS declared, CAST(a.n AS BIGINT) AS actual FROM d FULL JOIN a USING (host, event_type) WHERE d.n IS DISTINCT FROM a.n""")
def reconcile_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of declared count maps that aren't the computed ones without zeros."""
    events = table(spark, sf_dir, "events").withColumn("host", F.col("user_id") % 10)
    declared = events.filter("user_id % 3 <> 0").groupBy("host", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return checks.reconcile(declared, checks.nonzero_sums(events, ["host", "event_type"], F.when(F.col("value") > 50, 1).otherwise(0)), ["host", "event_type"])


@query("""SELECT o_custkey, CAST(CASE WHEN bool_and(o_totalprice < 400000) THEN count(*) END AS BIGINT) AS n FROM orders GROUP BY 1""")
def suppress_if_any_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's count, withheld if any order's price is out of bounds."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(F.bool_and(F.col("o_totalprice") < 400000), F.count(F.lit(1))).alias("n"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, list(DISTINCT event_type) AS flags FROM events GROUP BY 1, 2)
SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM d) WHERE flag <> 'view' GROUP BY 1""")
def distinct_flag_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many user-days have each flag, each once a day."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("flags"))
    return days.select(F.explode(F.filter("flags", lambda f: f != "view")).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH k AS (SELECT DISTINCT o_custkey AS key FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier)
SELECT key, o IS NOT NULL AS has_orders FROM k LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON o = key""")
def partition_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of three tables, and whether one of them has rows for each."""
    has = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct().withColumn("o", F.lit(True))
    keys = has.select("key").union(table(spark, sf_dir, "customer").select("c_custkey")).union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()
    return keys.join(has, "key", "left").select("key", F.col("o").isNotNull().alias("has_orders"))


@query("""SELECT user_id FROM events GROUP BY 1 HAVING list_sort(list(DISTINCT event_type)) <> ['click', 'error', 'view']""")
def completeness_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose set of event types isn't exactly the required one."""
    return checks.incomplete(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click", "error"]).select("user_id")


# --- scalar rules -------------------------------------------------------------------------------------------------------------
@query("""SELECT event_type, event_type IN ('click', 'view', 'purchase') AS allowed, count(*) AS n FROM events GROUP BY 1, 2""")
def enum_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.col("event_type").isin("click", "view", "purchase").alias("allowed")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, NOT (p_size BETWEEN 0 AND 40) AS size_issue, length(p_name) > 20 AS name_issue FROM part WHERE NOT (p_size BETWEEN 0 AND 40) OR length(p_name) > 20""")
def bounded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name = ~F.col("p_size").between(0, 40), F.char_length("p_name") > 20
    return table(spark, sf_dir, "part").filter(size | name).select("p_partkey", size.alias("size_issue"), name.alias("name_issue"))


@query(f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) > {fixed.MAX_TEXT}")
def text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.char_length("text") > fixed.MAX_TEXT).select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"))


@query(f"""WITH e AS (SELECT event_id, {ISO} AS iso FROM events) SELECT event_id, CAST(regexp_matches(iso, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}[.][0-9]{{9}}Z$') AS BOOLEAN) AS valid, substr(iso, 1, 29) AS order_key FROM e""")
def ts_parts_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity and order key of nanosecond timestamps."""
    return _iso(table(spark, sf_dir, "events")).select("event_id", times.valid(F.col("iso")).alias("valid"), times.key(F.col("iso")).alias("order_key"))


@query("""WITH w AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + to_days(CAST(o_orderkey % 3 AS INT) * 3 + 1) AS b, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS more, [1, 7, 90][o_orderkey % 3 + 1] AS days FROM orders)
SELECT o_orderkey, epoch_us(b) * 1000 + more - epoch_us(a) * 1000 = days * 86400000000000 AS exact FROM w""")
def duration_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a window lasts the days of its mode: 1, 4 or 7 days from the order's date, every fourth a nanosecond more, held against 1, 7 or 90."""
    shape = "yyyy-MM-dd'T'HH:mm:ss"
    start = times.key(F.concat(F.date_format("o_orderdate", shape), F.lit("Z")))
    end = F.date_format(F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 3 AS INT) * 3 + 1)"), shape)
    end = times.key(F.concat(end, F.when(F.col("o_orderkey") % 4 == 0, ".000000001Z").otherwise("Z")))
    days = F.element_at(F.array(*map(F.lit, fixed.MODE_DAYS.values())), (F.col("o_orderkey") % 3).cast("int") + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", times.lasts(start, end, days).alias("exact"))


@query("""SELECT event_id, regexp_full_match(ref, 'episode_ref_v1:[0-9a-f]{20}') AS valid FROM (SELECT event_id, 'episode_ref_v1:' || substr(md5(CAST(user_id AS VARCHAR)), 1, CASE WHEN event_id % 7 = 0 THEN 19 ELSE 20 END) || CASE WHEN event_id % 11 = 0 THEN chr(10) ELSE '' END AS ref FROM events)""")
def ref_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque references, some cut short, some with a line end behind."""
    ref = F.concat(F.lit("episode_ref_v1:"), F.expr("substr(md5(CAST(CAST(user_id AS STRING) AS BINARY)), 1, CASE WHEN event_id % 7 = 0 THEN 19 ELSE 20 END)"), F.when(F.col("event_id") % 11 == 0, "\n").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", ref.rlike(fixed.EPISODE_REF).alias("valid"))


# --- JSON ---------------------------------------------------------------------------------------------------------------------
PROPS = """'{"k":' || json_extract(props, '$.k') || CASE event_id % 4 WHEN 0 THEN ',"root":null' WHEN 1 THEN ',"a":{"path":1}' WHEN 2 THEN ',"k2":1.0' ELSE '' END || '}'"""


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a JSON text that has more keys, by the id."""
    extra = F.expr("""CASE event_id % 4 WHEN 0 THEN ',"root":null' WHEN 1 THEN ',"a":{"path":1}' WHEN 2 THEN ',"k2":1.0' ELSE '' END""")
    k = F.to_json(jsonv.field(F.try_parse_json("props"), "k"))
    json = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"k":'), k, extra, F.lit("}")).alias("json"))
    return json.withColumn("doc", jsonv.strict(F.col("json")))


@query(f"SELECT event_id, len(list_filter(json_keys(p), lambda x: x NOT IN ('k', 'k2'))) > 0 AS unexpected FROM (SELECT event_id, CAST({PROPS} AS JSON) AS p FROM events)")
def json_closed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a key outside the closed set."""
    keys = jsonv.keys(F.col("doc"))
    return _props(spark, sf_dir).select("event_id", (F.size(F.array_except(keys, F.array(F.lit("k"), F.lit("k2")))) > 0).alias("unexpected"))


@query(f"SELECT event_id, unnest(list_filter(['a', 'k', 'k2'], lambda x: NOT list_contains(json_keys(p), x))) AS missing FROM (SELECT event_id, CAST({PROPS} AS JSON) AS p FROM events)")
def json_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required keys that each record lacks."""
    return _props(spark, sf_dir).select("event_id", F.explode(F.array_except(F.array(F.lit("a"), F.lit("k"), F.lit("k2")), jsonv.keys(F.col("doc")))).alias("missing"))


@query(f"SELECT event_id, coalesce(json_type(p, '$.root') = 'NULL', FALSE) AS root_null, coalesce(json_type(p, '$.k2') IN ('BIGINT', 'UBIGINT'), FALSE) AS k2_int FROM (SELECT event_id, CAST({PROPS} AS JSON) AS p FROM events)")
def json_strict_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null is a value and 1.0 is no integer."""
    root, k2 = jsonv.field(F.col("doc"), "root"), jsonv.field(F.col("doc"), "k2")
    return _props(spark, sf_dir).select("event_id", (jsonv.kind(root) == "VOID").alias("root_null"), jsonv.integer(k2).isNotNull().alias("k2_int"))


@query(f"SELECT event_id FROM (SELECT event_id, CAST({PROPS} AS JSON) AS p FROM events) WHERE list_contains(json_keys(p), 'root') OR json_exists(p, '$.a.path')")
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a raw location key at any depth."""
    return _props(spark, sf_dir).filter(F.exists(jsonv.deep_keys(F.col("json")), lambda k: k.isin("root", "path"))).select("event_id")


# --- text and paths -------------------------------------------------------------------------------------------------------------
#: The 21 patterns in the oracle's dialect, which has no look-around: an edge there is a character here, or the text's begin or end.
SQL_HITS = {
    "private_key": r"(?i)-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----",
    "url": r"(?i)\b(https?|ssh)://",
    "git_remote": r"\bgit@[A-Za-z0-9_.-]+:",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "posix_path": r"(?i)(^|[^A-Za-z0-9_])(~|/(Users|home|root|private|tmp|var|etc|opt|Volumes|workspace|workspaces))/",
    "tool_state": r"(?i)(^|[^A-Za-z0-9_])(\./|\.\./)?\.codex(-local|-tmp)?[/\\]",
    "sessions": r"(?i)(^|[^A-Za-z0-9_])(archived_)?sessions[/\\]",
    "windows_path": r"(?i)\b[A-Za-z]:\\(Users|home|root|private|tmp|var|etc|opt|workspaces?)\\",
    "secret_assignment": r"(?i)(password|passwd|pwd|credential|secret([\s._-]+key)?|token|api[\s._-]*key|authorization|private[\s._-]*key)[A-Za-z0-9._-]*[\"']?\s*[:=]",
    "bearer": r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}(\b|[~+/=.-]\b)",
    "api_key": r"\b(sk|rk)[-_](proj[-_])?[A-Za-z0-9_-]{16,}\b",
    "bare_token": r"\b(gh[pousr]_[A-Za-z0-9_]{16,}|github_pat_[A-Za-z0-9_]{16,})\b",
    "hex64": r"(^|[^0-9a-fA-F])[0-9a-fA-F]{64}([^0-9a-fA-F]|$)",
    "uuid": r"\b[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b",
    "rollout_name": r"(?i)\brollout(-summary)?-[A-Za-z0-9_.-]+\.jsonl\b",
    "private_ipv4": r"(^|[^0-9.])((10|127)(\.[0-9]{1,3}){3}|(100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])|169\.254|172\.(1[6-9]|2[0-9]|3[01])|192\.168)(\.[0-9]{1,3}){2})([^0-9.]|$)",
    "private_ipv6": r"(?i)(^|[^0-9a-f:])(::1|f[cd][0-9a-f]{0,2}(:[0-9a-f]{0,4}){1,7}|fe[89ab][0-9a-f]?(:[0-9a-f]{0,4}){1,7})([^0-9a-f:]|$)",
    "raw_id_value": r"(?i)(^|[^a-z0-9_])[\"']?(session|turn|episode)[._ -]?id[\"']?(\s*[:=]\s*|\s+)[\"']?[a-z0-9_.:-]{6,}\b",
    "raw_id_token": r"(?i)\b(session|turn|episode)[._-]?id[._-][a-z0-9][a-z0-9_.-]{5,}\b",
    "reserved_domain": r"(?i)\b([a-z0-9-]+\.)+(internal|corp|local|lan|example|invalid|test)\b",
    "safety_words": r"(?i)\b(secret|token|credential|password|private key|production|destructive|rm -rf|reset --hard|customer data|pii)\b|客户|凭据|凭证|密钥|生产|破坏性",
}
#: What is put behind the texts, so that every pattern has something to find and something to leave.
SAMPLES = [
    "", "-----BEGIN RSA PRIVATE" + " KEY-----", "ssh" + "://x", "git" + "@host:x", "a" + "@b.org", "/ho" + "me/x", "./.co" + "dex/x", "archived_" + "sessions/x", "C:" + "\\Users\\x", "pass" + "wd = x",
    "Bear" + "er abcdefgh1234567", "sk" + "-proj-abcdefghijklmnopqrst", "gh" + "p_" + "a" * 20, "f" * 64, "f" * 65, "01234567-89ab-cdef-0123-456789abcdef", "rollout" + "-x.jsonl", "at 10.1" + ".2.3", "110.1.2.3",
    "10.1.2.3.4", "172.32.0.1", "fe80" + "::1", "g::1", "session" + " id: abcdef1", "session id: abc", "turn" + "_id_abcdef1", "db.prod" + ".internal", "a.localx", "the pro" + "duction", "凭" + "证", "tokens",
]


def _sampled(duck: bool) -> str:
    """The documents' texts with a sample behind each."""
    each = " ".join(f"WHEN {i} THEN '{x if duck else x.replace(chr(92), chr(92) * 2)}'" for i, x in enumerate(SAMPLES))
    return f"coalesce(text, '') || ' ' || CASE doc_id % {len(SAMPLES)} {each} END"


def _sql_hits(source: str, column: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{name}' AS pattern FROM {source} WHERE regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}')" for name, p in SQL_HITS.items())


@query(f"WITH d AS (SELECT doc_id, {_sampled(True)} AS body FROM documents) SELECT * FROM ({_sql_hits('d', 'body')})")
def risk_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each with a sample behind it, and the sensitive patterns in them."""
    body = table(spark, sf_dir, "documents").select("doc_id", F.expr(_sampled(False)).alias("body"))
    return body.select("doc_id", F.explode(text.patterns_in(F.col("body"), list(SQL_HITS))).alias("pattern"))


@query(f"SELECT DISTINCT doc_id FROM ({_sql_hits('documents', 'text')})")
def risky_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any pattern of the retained bank."""
    return table(spark, sf_dir, "documents").filter(text.risky_document(F.col("text"))).select("doc_id").distinct()


@query(r"""SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) NOT IN ('sessions/', 'auth.json') AND regexp_matches(line, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') GROUP BY 1""")
def line_scan_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an address, but for the lines known as safe."""
    bad = F.filter(text.lines(F.col("text")), lambda x: ~F.trim(x).isin("sessions/", "auth.json") & text.hits(x, ["email"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(bad).cast("bigint").alias("n")).filter("n > 0")


MADE_PATHS = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'retained/daily/episodes.jsonl' WHEN 1 THEN 'data/trends/2026/' || lpad(CAST(user_id % 15 AS VARCHAR), 2, '0') || '/trend_report.json' WHEN 2 THEN 'raw/' || user_id || '.txt'
WHEN 3 THEN 'retained/weekly/retained_manifest.json' WHEN 4 THEN 'data/episodes/0000/05/episodes.jsonl' WHEN 5 THEN 'reports/daily/2026/02/' || lpad(CAST(user_id % 32 AS VARCHAR), 2, '0') || '.md' WHEN 6 THEN 'data/turn_flags/9999/12/turn_flags.jsonl'
WHEN 7 THEN 'notes/session_id_' || md5(CAST(user_id AS VARCHAR)) || '.md.gz' ELSE 'scripts/x.py' END AS path FROM events"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = MADE_PATHS.replace("VARCHAR", "STRING").replace("md5(CAST(user_id AS STRING))", "md5(CAST(CAST(user_id AS STRING) AS BINARY))").replace(" FROM events", "")
    columns = made.removeprefix("SELECT event_id, ")
    return table(spark, sf_dir, "events").select("event_id", F.expr(columns.rsplit(" AS path", 1)[0]).alias("path")).withColumn("parts", F.split("path", "/"))


@query(f"""WITH p AS ({MADE_PATHS}), q AS (SELECT event_id, path, string_split(path, '/') AS x FROM p), r AS (SELECT *, len(x) = 5 AND x[1] = 'data' AND x[3] <> '0000' AND CAST(x[4] AS INT) BETWEEN 1 AND 12 AND NOT (x[3] = '9999' AND x[4] = '12') AS month FROM q WHERE x[1] = 'data'
UNION ALL SELECT *, FALSE FROM q WHERE x[1] <> 'data')
SELECT event_id, CASE WHEN x[1] = 'retained' AND x[3] = 'episodes.jsonl' THEN 'episode' WHEN x[1] = 'retained' THEN 'manifest' WHEN month AND x[2] = 'trends' THEN 'trend' WHEN month AND x[2] = 'episodes' THEN 'episode' WHEN month AND x[2] = 'turn_flags' THEN 'turn_flag' END AS kind,
CASE WHEN x[1] = 'retained' THEN x[1] || '/' || x[2] END AS export_key, CASE WHEN month THEN 'data/' || x[3] || '/' || x[4] END AS month_key, x[1] = 'reports' AND coalesce(TRY_CAST(left(x[5], 2) AS INT) BETWEEN 1 AND 28, FALSE) AS report, x[1] IN ('raw', 'notes') AS forbidden, x[1] = 'scripts' AS infrastructure FROM r""")
def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, partition and admission of made-up paths."""
    path, parts = F.col("path"), F.col("parts")
    return _paths(spark, sf_dir).select("event_id", paths.kind(parts).alias("kind"), paths.export_key(parts).alias("export_key"), paths.month_key(parts).alias("month_key"), paths.text_report(path, parts).alias("report"), paths.forbidden(parts).alias("forbidden"), paths.infrastructure(path, parts).alias("infrastructure"))


@query(f"SELECT event_id, CASE WHEN path LIKE 'notes/%' THEN 'notes/[redacted].md.gz' ELSE path END AS shown FROM ({MADE_PATHS})")
def redact_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as messages may show them."""
    return _paths(spark, sf_dir).select("event_id", paths.shown(F.col("parts")).alias("shown"))


@query("""WITH s AS (SELECT user_id, ['empty', 'missing', 'ready', 'stale', 'other'][CAST(user_id % 5 AS INT) + 1] AS status, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)
SELECT user_id, CASE WHEN status = 'other' THEN 'source status is invalid' WHEN status = 'ready' AND a < 1 AND b < 1 THEN 'ready source must have rollout_count or summary_count' WHEN status <> 'ready' AND (a <> 0 OR b <> 0) THEN 'non-ready source counts must be zero' END AS issue FROM s""")
def source_status_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that hold by status."""
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    status = F.element_at(F.array(*map(F.lit, [*fixed.SOURCE_STATUSES, "other"])), (F.col("user_id") % 5).cast("int") + 1)
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(n("click").alias("a"), n("view").alias("b")).withColumn("status", status)
    issue = F.when(~F.col("status").isin(fixed.SOURCE_STATUSES), "source status is invalid").when((F.col("status") == "ready") & (F.col("a") < 1) & (F.col("b") < 1), "ready source must have rollout_count or summary_count")
    return s.select("user_id", issue.when((F.col("status") != "ready") & ((F.col("a") != 0) | (F.col("b") != 0)), "non-ready source counts must be zero").alias("issue"))


@query(f"""SELECT 1 AS phase, l_orderkey AS key, 'duplicate line' AS message FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LINE_ORDER)}) AS o FROM lineitem) WHERE o > 1
UNION ALL SELECT 2, o_orderkey, 'price out of bounds' FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 3, c_custkey, 'negative balance' FROM customer WHERE c_acctbal < 0""")
def bag_union_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of several checks as one ordered bag: equal ones stay."""
    issue = lambda df, phase, key, message: df.select(F.lit(phase).alias("phase"), F.col(key).alias("key"), F.lit(message).alias("message"))
    found = issue(checks.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER), 1, "l_orderkey", "duplicate line")
    found = found.unionByName(issue(table(spark, sf_dir, "orders").filter("o_totalprice > 400000"), 2, "o_orderkey", "price out of bounds"))
    return found.unionByName(issue(table(spark, sf_dir, "customer").filter("c_acctbal < 0"), 3, "c_custkey", "negative balance")).orderBy("phase", "key", "message")


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, user_id % 4 AS host, event_type FROM events), ep AS (SELECT day, user_id, any_value(host) AS host, count(*) AS turns FROM e GROUP BY 1, 2), fl AS (SELECT day, user_id, count(*) AS flagged FROM e WHERE event_type = 'error' GROUP BY 1, 2),
a AS (SELECT day, host, count(*) AS episodes, sum(turns) AS turns, coalesce(sum(flagged), 0) AS flagged FROM ep LEFT JOIN fl USING (day, user_id) GROUP BY 1, 2), d AS (SELECT day, host, count(*) AS declared FROM e WHERE user_id % 13 <> 0 GROUP BY 1, 2)
SELECT day, host, CAST(episodes AS BIGINT) AS episodes, CAST(turns AS BIGINT) AS turns, CAST(flagged AS BIGINT) AS flagged, CAST(declared AS BIGINT) AS declared, turns IS NOT DISTINCT FROM declared AS matches FROM a FULL JOIN d USING (day, host)""")
def episode_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily trend by host, reconciled with a declared one: user-days are episodes, their events turns, errors flags."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", (F.col("user_id") % 4).alias("host"), "event_type")
    episodes = e.groupBy("day", "user_id", "host").agg(F.count(F.lit(1)).alias("turns"), F.count(F.when(F.col("event_type") == "error", 1)).alias("flagged"))
    actual = episodes.groupBy("day", "host").agg(F.count(F.lit(1)).alias("episodes"), F.sum("turns").alias("turns"), F.sum("flagged").alias("flagged"))
    declared = e.filter("user_id % 13 <> 0").groupBy("day", "host").agg(F.count(F.lit(1)).alias("declared"))
    return actual.join(declared, ["day", "host"], "full_outer").select("day", "host", "episodes", "turns", "flagged", "declared", F.col("turns").eqNullSafe(F.col("declared")).alias("matches"))


QUERIES |= record_queries.QUERIES
ORACLE_SQL |= record_queries.ORACLE_SQL
