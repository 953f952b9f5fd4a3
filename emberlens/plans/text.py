"""Queries of the text functions, the corpus profile and flow comparison over log lines made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.functions import text as T
from emberlens.operators import profile as P
from emberlens.plans.adapters import RECORDS_SQL, event_records
from emberlens.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, line: events written as log lines of eight layouts."""
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    i = F.col("event_id")
    day, clock = F.date_format("t", "yyyy-MM-dd"), F.date_format("t", "HH:mm:ss")
    frac = F.lpad((F.unix_millis("t") % 1000).cast("string"), 3, "0")
    lv = F.when(F.col("event_type") == "error", "ERROR").when(i % 3 == 0, "WARNING").otherwise("INFO")
    who = F.concat(F.lit("exec-"), (F.col("user_id") % 20).cast("string"))
    site = F.concat(F.initcap("event_type"), F.lit("Controller:"), (i % 90 + 1).cast("string"))
    kv = F.concat(F.lit("orderId="), i.cast("string"), F.lit(" kind="), F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" meta={a="), (i % 5).cast("string"), F.lit(", b=x} kind="), F.upper("event_type"))
    c = F.concat
    forms = [
        c(day, F.lit(" "), clock, F.lit("."), frac, F.lit(" | "), lv, F.lit(" | "), who, F.lit(" | "), site, F.lit(" | "), kv),
        c(day, F.lit("T"), clock, F.lit(","), frac, F.lit(" "), lv, F.lit(" [worker-"), (i % 4).cast("string"), F.lit("] "), site, F.lit(" - "), kv),
        c(day, F.lit(" "), clock, F.lit(" "), lv, F.lit(" thread="), who, F.lit(" failed to serve "), F.sha1(i.cast("string"))),
        F.lit("    at com.acme.shop.Handler.run(Handler.java:12)"),
        c(F.lit("Caused by: java.lang.IllegalStateException: order "), i.cast("string")),
        c(F.date_format("t", "dd/MM/yyyy"), F.lit(" "), clock, F.lit(" [INFO] [main] started "), kv),
        c(clock, F.lit("."), frac, F.lit(' {"kind": "'), F.col("event_type"), F.lit('", "trace_id": "t'), i.cast("string"), F.lit('"}')),
        c(day, F.lit(" "), clock, F.lit("."), frac, F.lit("123456 pool-2-thread-7 DEBUG tick")),
    ]
    line = forms[-1]
    for k in range(len(forms) - 2, -1, -1):
        line = F.when(i % len(forms) == k, forms[k]).otherwise(line)
    return e.select("event_id", F.col("user_id"), line.alias("line"))


LINES_SQL = """
l0 AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS clock, lpad((epoch_ns(ts) // 1000000 % 1000)::VARCHAR, 3, '0') AS frac, 'exec-' || user_id % 20 AS who,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_id % 3 = 0 THEN 'WARNING' ELSE 'INFO' END AS lv, upper(event_type[1]) || event_type[2:] || 'Controller:' || (event_id % 90 + 1) AS site,
  'orderId=' || event_id || ' kind=' || event_type || ' user=' || user_id || ' meta={a=' || event_id % 5 || ', b=x} kind=' || upper(event_type) AS kv FROM events),
l AS (SELECT event_id, user_id, CASE event_id % 8
  WHEN 0 THEN day || ' ' || clock || '.' || frac || ' | ' || lv || ' | ' || who || ' | ' || site || ' | ' || kv
  WHEN 1 THEN day || 'T' || clock || ',' || frac || ' ' || lv || ' [worker-' || event_id % 4 || '] ' || site || ' - ' || kv
  WHEN 2 THEN day || ' ' || clock || ' ' || lv || ' thread=' || who || ' failed to serve ' || sha1(event_id::VARCHAR)
  WHEN 3 THEN '    at com.acme.shop.Handler.run(Handler.java:12)'
  WHEN 4 THEN 'Caused by: java.lang.IllegalStateException: order ' || event_id
  WHEN 5 THEN strftime(ts, '%d/%m/%Y') || ' ' || clock || ' [INFO] [main] started ' || kv
  WHEN 6 THEN clock || '.' || frac || ' {"kind": "' || event_type || '", "trace_id": "t' || event_id || '"}'
  ELSE day || ' ' || clock || '.' || frac || '123456 pool-2-thread-7 DEBUG tick' END AS line FROM l0)"""
_L = "WITH " + LINES_SQL


@query(_L + """ SELECT event_id, epoch_ms(coalesce(
  try_strptime(replace(replace(nullif(regexp_extract(line, '\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}[.,]\\d{1,6}(?:\\D|$)')[1:23], ''), ',', '.'), 'T', ' '), '%Y-%m-%d %H:%M:%S.%g'),
  try_strptime(replace(nullif(regexp_extract(line, '\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}'), ''), 'T', ' '), '%Y-%m-%d %H:%M:%S'),
  try_strptime(nullif(regexp_extract(line, '\\d{2}/\\d{2}/\\d{4}[T ]\\d{2}:\\d{2}:\\d{2}'), ''), '%d/%m/%Y %H:%M:%S'),
  try_strptime('1900-01-01 ' || nullif(regexp_extract(line, '\\d{2}:\\d{2}:\\d{2}[.,]\\d{1,3}'), ''), '%Y-%m-%d %H:%M:%S.%g'))) AS ts_ms FROM l""".replace("\\\\", "\\"))
def fn_parse_ts(spark, sf):
    return event_lines(spark, sf).select("event_id", F.unix_millis(T.parse_ts(F.col("line"))).alias("ts_ms"))


@query(_L + r""" SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]\d{1,9}', ' ', 'g'), '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}', ' ', 'g'), '\d{2}/\d{2}/\d{4}[T ]\d{2}:\d{2}:\d{2}', ' ', 'g'), '\d{2}:\d{2}:\d{2}[.,]\d{1,3}', ' ', 'g') AS rest FROM l""")
def fn_strip_ts(spark, sf):
    return event_lines(spark, sf).select("event_id", T.strip_ts(F.col("line")).alias("rest"))


@query(_L + r" SELECT event_id, nullif(regexp_extract(line, '\b([A-Za-z_][A-Za-z0-9_.$]*):(\d{1,6})\b'), '') AS site FROM l")
def fn_call_site(spark, sf):
    return event_lines(spark, sf).select("event_id", T.call_site(F.col("line")).alias("site"))


@query(_L + r" SELECT event_id, CASE w WHEN 'WARNING' THEN 'WARN' WHEN '' THEN NULL ELSE w END AS level FROM (SELECT event_id, regexp_extract(line, '\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|SEVERE)\b') AS w FROM l)")
def fn_level(spark, sf):
    return event_lines(spark, sf).select("event_id", T.level(F.col("line")).alias("level"))


@query(_L + r""" SELECT event_id, coalesce(nullif(regexp_extract(line, '\bthread(?:[Nn]ame)?\s*[=:]\s*"?([\w.\-]+)"?', 1), ''), nullif(regexp_extract(line, '\b((?:http-[\w.\-]*exec-\d+|pool-\d+-thread-\d+|[\w.\-]*exec(?:utor)?-\d+|Thread-\d+|main))\b', 1), ''),
  list_filter(regexp_extract_all(line, '\[([A-Za-z][\w.\-]{1,60})\]', 1), lambda t: NOT regexp_full_match(t, 'TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|SEVERE'))[1]) AS thread FROM l""")
def fn_thread(spark, sf):
    return event_lines(spark, sf).select("event_id", T.thread(F.col("line")).alias("thread"))


@query(_L + r""" SELECT event_id, regexp_matches(line, '^\s*(at\s+\S+\(|Caused by:|\.\.\.\s*\d+\s+more|[\w.$]+(Exception|Error)\b)') AS stack, regexp_matches(line, '(?i)\b(ERROR|FATAL|SEVERE|Exception|failed|failure)\b') AS error FROM l""")
def fn_is_stack(spark, sf):
    return event_lines(spark, sf).select("event_id", T.is_stack(F.col("line")).alias("stack"), T.is_error(F.col("line")).alias("error"))


@query(_L + r""" SELECT event_id, regexp_matches(line, '^    at ') OR regexp_matches(line, '^Caused by:') AS continuation FROM l""")
def fn_is_continuation(spark, sf):
    return event_lines(spark, sf).select("event_id", T.is_continuation(F.col("line")).alias("continuation"))


def _pairs(c):
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


_PAYLOAD = """CASE event_id % 8 WHEN 0 THEN {order}'a=' || event_id % 5 || ';b=x;kind=' || upper(event_type){ord2} || ';user=' || user_id
  WHEN 1 THEN {order}'a=' || event_id % 5 || ';b=x;kind=' || upper(event_type){ord2} || ';user=' || user_id WHEN 2 THEN 'thread=' || who
  WHEN 5 THEN 'a=' || event_id % 5 || ';b=x;kind=' || upper(event_type){ord2} || ';user=' || user_id WHEN 6 THEN 'kind=' || event_type{tr} ELSE '' END"""
_FRAMES = "WHEN 3 THEN 'Handler.java=12' WHEN 4 THEN 'by=java.lang.IllegalStateException:' ELSE ''"
_SITE = "upper(event_type[1]) || event_type[2:] || 'Controller=' || (event_id % 90 + 1) || ';' || "


@query(_L + ", x AS (SELECT * FROM l JOIN l0 USING (event_id)) SELECT event_id, " + _PAYLOAD.format(order=_SITE, ord2=" || ';orderId=' || event_id", tr=" || ';trace_id=t' || event_id").replace("ELSE ''", _FRAMES) + " AS pairs FROM x")
def fn_payload(spark, sf):
    return event_lines(spark, sf).select("event_id", _pairs(T.payload(F.col("line"))).alias("pairs"))


@query(_L + ", x AS (SELECT * FROM l JOIN l0 USING (event_id)) SELECT event_id, " + _PAYLOAD.format(order=_SITE, ord2="", tr="").replace("ELSE ''", _FRAMES) + " AS pairs FROM x")
def fn_significant_payload(spark, sf):
    return event_lines(spark, sf).select("event_id", _pairs(T.significant_payload(F.col("line"))).alias("pairs"))


@query(_L + r""", x AS (SELECT * FROM l JOIN l0 USING (event_id)) SELECT event_id, CASE event_id % 8
  WHEN 0 THEN who2 || ' | ' || site2 || ' | orderId=? kind=? user=? meta=? kind=' || tail WHEN 1 THEN '[worker-?] ' || site2 || ' - orderId=? kind=? user=? meta=? kind=' || tail
  WHEN 2 THEN 'thread=? failed to serve ?' WHEN 3 THEN 'at com.acme.shop.Handler.run(Handler.java:?)' WHEN 4 THEN 'Caused by: java.lang.IllegalStateException: order ?'
  WHEN 5 THEN '[ ] [main] started orderId=? kind=? user=? meta=? kind=' || tail WHEN 6 THEN '{"kind": ?, "trace_id": ?}' ELSE 'pool-?-thread-? tick' END AS template
  FROM (SELECT *, 'exec-?' AS who2, CASE WHEN event_type = 'error' THEN '' ELSE '?' END AS tail, upper(event_type[1]) || event_type[2:] || 'Controller:?' AS site2 FROM x)""")
def fn_template(spark, sf):
    return event_lines(spark, sf).select("event_id", T.template(F.col("line")).alias("template"))


@query(_L + r""", x AS (SELECT event_id, regexp_extract(line, '^(\S+ \S+)\s*\|\s*(\w+)\s*\|\s*([^|]+?)\s*\|\s*([^:|]+):(\d+)\s*\|\s*(.*)$', ['ts', 'level', 'thread', 'class_name', 'n', 'message']) AS g FROM l)
SELECT event_id, g.ts AS ts, g.level AS level, g.thread AS thread, g.class_name AS class_name, g.n::INT AS line_number, g.message AS message FROM x WHERE g.n <> ''""")
def fn_envelope(spark, sf):
    d = event_lines(spark, sf).select("event_id", T.envelope(F.col("line")).alias("e")).where("e is not null")
    return d.select("event_id", "e.*")


@query("SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS pool FROM customer")
def fn_thread_norm(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.thread_norm(F.col("c_name")).alias("pool"))


@query("SELECT p_partkey, sha1(p_name || '|' || p_brand || '|' || p_type)[1:12] AS signature FROM part")
def fn_stack_sig(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.stack_signature(F.array("p_name", "p_brand", "p_type")).alias("signature"))


@query("""SELECT p_partkey, ceil((12 + p_size * 3 - 4 * (p_size % 3)) / 8.0)::BIGINT * 8 AS instance_bytes, ceil((16 + p_size * 2) / 8.0)::BIGINT * 8 AS array_bytes FROM part""")
def fn_shallow_size(spark, sf):
    n = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", T.shallow_size(n * 3, n % 3).alias("instance_bytes"), T.shallow_size(n, F.lit(0), n, F.lit(2)).alias("array_bytes"))


@query("SELECT o_orderkey, 'E-' || sha256(o_orderpriority || '|' || o_orderstatus || '|' || o_orderkey || '|' || o_custkey)[1:12] AS evidence FROM orders")
def fn_evidence_id(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", T.evidence_id(F.col("o_orderpriority"), F.col("o_orderstatus"), F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))).alias("evidence"))


@query("SELECT CASE WHEN url LIKE '%.html' THEN 'html' ELSE 'other' END AS kind, count(DISTINCT CASE WHEN base = '' THEN 'ROOT' ELSE base END) AS names FROM (SELECT url, regexp_replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '(?i)\\.(war|ear|jar|xml)$', '') AS base FROM pages) GROUP BY ALL".replace("\\\\", "\\"))
def fn_artifact_name(spark, sf):
    kind = F.when(F.col("url").endswith(".html"), "html").otherwise("other")
    return table(spark, sf, "pages").groupBy(kind.alias("kind")).agg(F.countDistinct(T.artifact_name(F.col("url"))).alias("names"))


@query("SELECT event_id, regexp_extract(props, '\\{\"k\": ([0-9]+)', 1)::INT AS k FROM events".replace("\\\\", "\\"))
def fn_json_value(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT CASE WHEN n <= 1 THEN '<=1' WHEN n <= 10 THEN '<=10' WHEN n <= 100 THEN '<=100' WHEN n <= 1000 THEN '<=1000' WHEN n <= 10000 THEN '<=10000' ELSE '>10000' END AS bucket, count(*) AS threads FROM c GROUP BY ALL")
def fn_bucket(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return c.groupBy(P.count_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("threads"))


_CLASSES = ["java.lang.String", "com.acme.shop.Order$Line[]", "org.springframework.web.Filter", "byte[]", "Main", "io.netty.util.Timer", "com.acme.Cart", "kotlin.Unit"]


def _names(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in _CLASSES])
    return table(spark, sf, "part").select("p_partkey", F.get(names, F.col("p_partkey").cast("int") % len(_CLASSES)).alias("name"))


_N = "WITH n AS (SELECT p_partkey, " + "[" + ", ".join(f"'{c}'" for c in _CLASSES) + "][p_partkey % 8 + 1] AS name FROM part)"


@query(_N + r""" SELECT p_partkey, string_split(regexp_replace(name, '(\[\])+$', ''), '$')[1] AS outer_class, list_last(string_split(name, '.')) AS simple, CASE WHEN contains(name, '.') THEN regexp_replace(name, '\.[^.]*$', '') ELSE '(default)' END AS package,
 name IN ('com.acme.shop.Order$Line[]', 'Main', 'com.acme.Cart') AS user_code FROM n""")
def fn_is_user_code(spark, sf):
    n = F.col("name")
    return _names(spark, sf).select("p_partkey", T.outer_class(n).alias("outer_class"), T.simple_class(n).alias("simple"), T.package_of(n).alias("package"), T.is_user_code(n).alias("user_code"))


@query("WITH d AS (SELECT p_partkey, ['Ljava/lang/String;', '[B', '[[I', 'com/acme/Cart', '[Lcom/acme/Cart;', 'J'][p_partkey % 6 + 1] AS d FROM part) SELECT p_partkey, map {'Ljava/lang/String;': 'java.lang.String', '[B': 'byte[]', '[[I': 'int[][]', 'com/acme/Cart': 'com.acme.Cart', '[Lcom/acme/Cart;': 'com.acme.Cart[]', 'J': 'J'}[d] AS name FROM d")
def fn_class_name(spark, sf):
    d = F.get(F.array(*[F.lit(x) for x in ("Ljava/lang/String;", "[B", "[[I", "com/acme/Cart", "[Lcom/acme/Cart;", "J")]), F.col("p_partkey").cast("int") % 6)
    return table(spark, sf, "part").select("p_partkey", T.class_name(d).alias("name"))


# ---- corpus profile


def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    return event_records(spark, sf).withColumn("file", F.concat(F.lit("f"), (F.col("o2") % 4).cast("string")))


_R = "WITH " + RECORDS_SQL
_MARKS = (
    _R
    + """, g0 AS (SELECT *, lag(ts_ms) OVER w AS prev_ms, lag(call_site) OVER w AS prev_site, lead(ts_ms) OVER w IS NULL AS is_last FROM r WINDOW w AS (PARTITION BY flow_key ORDER BY ts_ms, event_id)),
g AS (SELECT *, greatest(ts_ms - prev_ms, 0) / 1000 AS gap_s FROM g0), t AS (SELECT g.*, unnest([1.0, 5.0, 30.0])::DOUBLE AS threshold FROM g),
o AS (SELECT threshold, call_site, (gap_s IS NULL OR gap_s > threshold)::INT AS first, (NOT (gap_s IS NULL OR gap_s > threshold))::INT AS mid, is_last::INT AS last FROM t
  UNION ALL SELECT threshold, prev_site, 0, 0, coalesce(gap_s > threshold, false)::INT FROM t WHERE prev_site IS NOT NULL),
marks AS (SELECT threshold, call_site, sum(first)::BIGINT AS first, sum(mid)::BIGINT AS mid, sum(last)::BIGINT AS last FROM o GROUP BY ALL)"""
)


@query(_R + " SELECT 'f' || event_id % 4 AS file, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS records FROM r GROUP BY ALL")
def rec_bounds(spark, sf):
    return P.bounds(_profiled(spark, sf))


@query(_MARKS + " SELECT CASE WHEN gap_s < 0.1 THEN '<100ms' WHEN gap_s < 1 THEN '<1s' WHEN gap_s < 5 THEN '<5s' WHEN gap_s < 30 THEN '<30s' WHEN gap_s < 300 THEN '<300s' ELSE 'longer' END AS gap, count(*) AS n FROM g WHERE gap_s IS NOT NULL GROUP BY ALL")
def rec_gap_hist(spark, sf):
    return P.gap_histogram(_profiled(spark, sf))


@query(_MARKS + " SELECT * FROM marks")
def rec_entry_terminal(spark, sf):
    return P.entry_terminal(_profiled(spark, sf))


@query(_MARKS + ", c AS (SELECT threshold, call_site, 'entry' AS kind, first AS n, first / (first + mid) AS ratio FROM marks UNION ALL SELECT threshold, call_site, 'terminal', last, last / (first + mid) FROM marks) SELECT *, row_number() OVER (PARTITION BY threshold, kind ORDER BY ratio DESC, n DESC, call_site) AS rank FROM c QUALIFY rank <= 3")
def rec_candidates(spark, sf):
    return P.candidates(P.entry_terminal(_profiled(spark, sf)), 3)


@query(_MARKS + ", v AS (SELECT first, first / (first + mid) >= 0.8 AS strong FROM marks WHERE threshold = 5 AND first + mid >= 5), w AS (SELECT count(*) FILTER (strong) AS strong_sites, coalesce(100.0 * sum(CASE WHEN strong THEN first ELSE 0 END)::DOUBLE / sum(first)::DOUBLE, 0) AS share_pct FROM v) SELECT *, share_pct >= 70 AND strong_sites <= 30 AS entry_markers FROM w")
def rec_verdict(spark, sf):
    return P.entry_verdict(P.entry_terminal(_profiled(spark, sf)))


@query(_R + """ SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H') AS hour, count(*) FILTER (level = 'ERROR') AS "ERROR", count(*) FILTER (level = 'INFO') AS "INFO" FROM r GROUP BY ALL""")
def rec_levels(spark, sf):
    return P.levels_by_hour(_profiled(spark, sf), ["ERROR", "INFO"])


@query(_R + " SELECT call_site, count(*) AS n FROM r GROUP BY ALL ORDER BY n DESC, call_site LIMIT 3")
def rec_callsites(spark, sf):
    return P.call_sites(_profiled(spark, sf), 3)


@query(_N + " SELECT CASE WHEN name LIKE 'java.%' THEN 'jdk' WHEN name LIKE 'org.springframework%' THEN 'spring' WHEN name LIKE 'io.netty%' THEN 'netty' WHEN NOT contains(name, '.') THEN '(simple) ' || string_split(name, '$')[1] ELSE array_to_string(string_split(name, '.')[1:3], '.') END AS package, count(*) AS n FROM n GROUP BY ALL")
def rec_packages(spark, sf):
    return _names(spark, sf).groupBy(P.package_prefix(F.col("name")).alias("package")).agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT user_id % 7 AS u, event_type, event_id % 4 AS file, event_id, ts FROM events), f AS (SELECT *, first_value(file) OVER (PARTITION BY u, event_type ORDER BY epoch_ns(ts) // 1000000, event_id) AS seen FROM k) SELECT count(*) FILTER (file <> seen) AS duplicates, count(DISTINCT CASE WHEN file <> seen THEN u || event_type END) AS keys FROM f")
def rec_dupes(spark, sf):
    d = _profiled(spark, sf).withColumn("u", F.col("thread_id").cast("bigint") % 7)
    return P.cross_file_duplicates(d, ["u", "call_site"])


@query(_R + ", t AS (SELECT flow_key, min(ts_ms) AS a, max(ts_ms) AS b FROM r GROUP BY ALL), e AS (SELECT min(a) AS low, max(b) AS high FROM t) SELECT count(*) FILTER (a <= low + 86400000) AS head_threads, count(*) FILTER (b >= high - 86400000) AS tail_threads FROM t, e")
def rec_boundary(spark, sf):
    return P.boundary(_profiled(spark, sf), 86_400_000)


@query(_R + " SELECT count(DISTINCT flow_key) AS threads, count(DISTINCT call_site) AS call_sites, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS records FROM r")
def parse_summary(spark, sf):
    return _profiled(spark, sf).agg(F.countDistinct("thread_id").alias("threads"), F.countDistinct("call_site").alias("call_sites"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("records"))
