"""Queries of cross-evidence operators and of sources whose files are written from the tables first."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.functions import text as T
from emberlens.operators import baseline as BASE
from emberlens.operators import detect as DET
from emberlens.operators import evidence as E
from emberlens.operators import gc as G
from emberlens.operators import rank as R
from emberlens.operators import segment as SEG
from emberlens.plans import evidence as PE
from emberlens.plans import flow as PF
from emberlens.plans import heap as PH
from emberlens.plans.adapters import EVENTS_CONFIG, RANKING_SQL, RECORDS_SQL
from emberlens.session import few, shared_dir, table
from emberlens.sources import lines as S
from emberlens.sources import artifacts, files, server_log, snapshots, synthetic, thread_dump

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _written(df: DataFrame, spark: SparkSession) -> str:
    """One text column as files of the shared folder, a value a line, line feeds inside kept."""
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def server_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    t = F.col("ts").cast("timestamp")
    i = F.col("event_id")
    at = F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("T"), F.date_format(t, "HH:mm:ss"), F.lit(".000Z "))
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    head = F.concat(at, level, F.lit(" [exec-1] com.acme.Shop - requestId=r"), i.cast("string"), F.lit(" served"))
    trace = F.concat(F.lit("\njava.lang.IllegalStateException: no\n\tat com.acme.Shop.pay(Shop.java:42)\nCaused by: java.lang.OutOfMemoryError: heap "), (i % 3).cast("string"))
    return e.select("event_id", F.when(F.col("event_type") == "error", F.concat(head, trace)).otherwise(head).alias("value"))


def mixed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same events as five kinds of servers write them: one with date and level, one with a date alone,
    one with a level alone, one in JSON, and one with the thread in parentheses."""
    e = table(spark, sf, "events")
    t, i, failed = F.col("ts").cast("timestamp"), F.col("event_id").cast("string"), F.col("event_type") == "error"
    day, clock = F.date_format(t, "yyyy-MM-dd"), F.date_format(t, "HH:mm:ss")
    level = F.when(failed, "ERROR").otherwise("INFO")
    stack = F.concat(F.lit("java.lang.IllegalStateException: no\n\tat com.acme.Shop.pay(Shop.java:42)\nCaused by: java.lang.OutOfMemoryError: heap "), (F.col("event_id") % 3).cast("string"))
    fields = {"@timestamp": F.concat(day, F.lit("T"), clock, F.lit("Z")), "severity": F.lower(level), "threadName": F.lit("exec-1"), "loggerName": F.lit("com.acme.Shop"), "correlationId": F.concat(F.lit("r"), i), "msg": F.lit("served"), "stacktrace": F.when(failed, stack)}
    forms = [
        F.concat(day, F.lit("T"), clock, F.lit(".000Z "), level, F.lit(" [exec-1] com.acme.Shop - requestId=r"), i, F.lit(" served")),
        F.concat(day, F.lit(" "), clock, F.lit(" worker started requestId=r"), i),
        F.concat(F.lit("WARN  [exec-1] com.acme.Shop: requestId=r"), i, F.lit(" slow")),
        F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])),
        F.concat(day, F.lit(" "), clock, F.lit(",000 "), level, F.lit("  [com.acme.Shop] (exec-1) correlation-id: r"), i, F.lit(" served")),
    ]
    value = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        value = F.when(F.col("event_id") % 5 == k, form if k == 3 else F.when(failed, F.concat(form, F.lit("\n"), stack)).otherwise(form)).otherwise(value)
    return e.select("event_id", value.alias("value"))


def _events(spark, sf):
    d = mixed_lines(spark, sf).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value")
    return server_log.events(S.read_lines(spark, _written(d, spark)))


_ML = "WITH ml AS (SELECT *, event_id % 5 AS form, event_type = 'error' AS failed, CASE event_id % 5 WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'WARN' ELSE CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END END AS level FROM events)"


@query(_ML + " SELECT level, CASE WHEN form = 3 THEN 'json' ELSE 'text' END AS format, count(*) AS events, count(*) FILTER (failed) AS frames, count(*) FILTER (failed) AS markers FROM ml GROUP BY ALL")
def src_server_log(spark, sf):
    e = _events(spark, sf)
    return e.groupBy("level", "format").agg(F.count("*").alias("events"), F.sum(F.size("frames")).alias("frames"), F.sum(F.size("markers")).alias("markers"))


@query(_ML + " SELECT 'r' || event_id AS request_id, level, CASE WHEN form <> 1 THEN 'exec-1' END AS thread, CASE WHEN form <> 1 THEN 'com.acme.Shop' END AS logger, CASE WHEN form IN (0, 3) THEN epoch_ns(ts) // 1000000000 END AS at, CASE WHEN failed THEN 'java.lang.OutOfMemoryError' END AS exception FROM ml")
def log_events(spark, sf):
    return _events(spark, sf).select("request_id", "level", "thread", "logger", F.unix_seconds("ts").alias("at"), "exception")


# the lines of server_lines in SQL
_SL = """WITH sl AS (SELECT event_id, event_type = 'error' AS failed, 'log/' || event_id // 4096 || '.log' AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' [exec-1] com.acme.Shop - requestId=r' || event_id || ' served' ||
  CASE WHEN event_type = 'error' THEN chr(10) || 'java.lang.IllegalStateException: no' || chr(10) || chr(9) || 'at com.acme.Shop.pay(Shop.java:42)' || chr(10) || 'Caused by: java.lang.OutOfMemoryError: heap ' || event_id % 3 ELSE '' END || chr(10) AS value FROM events)"""


def _server_files(spark: SparkSession, sf: str) -> str:
    """The folder of server logs of 4,096 events each."""
    d = server_lines(spark, sf).groupBy(F.floor(F.col("event_id") / 4096).alias("k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: F.concat(x["value"], F.lit("\n"))), "").alias("text"))
    return _put(spark, d.select(F.concat(F.lit("log/"), F.col("k").cast("string"), F.lit(".log")).alias("name"), F.encode("text", "UTF-8").alias("data")), "logs")


_SHORT = r"(log/[^/]*)$"


@query(_SL + ", p AS (SELECT *, sum(strlen(value)) OVER (PARTITION BY name ORDER BY event_id)::BIGINT AS byte_end FROM sl) SELECT 'r' || event_id AS request_id, name, byte_end - strlen(value) AS byte_start, byte_end FROM p")
def src_log_ranges(spark, sf):
    e = server_log.events(S.read_lines(spark, _server_files(spark, sf), with_bytes=True))
    return e.select("request_id", F.regexp_extract("file", _SHORT, 1).alias("name"), "byte_start", "byte_end")


@query(_SL + " SELECT name, sum(strlen(value))::BIGINT AS bytes, sum(CASE WHEN failed THEN 4 ELSE 1 END)::BIGINT AS lines, count(*) AS events, 0 AS truncated_events, 0 AS unrecognized_events, 0 AS unaligned_timestamps, 0 AS oversized_lines, 0 AS omitted_frames, 0 AS omitted_markers, 0 AS omitted_chars, 0 AS replacement_characters FROM sl GROUP BY name")
def src_log_accounts(spark, sf):
    a = server_log.accounts(server_log.events(S.read_lines(spark, _server_files(spark, sf), with_bytes=True)))
    counts = [F.col(c).cast("int" if c not in ("bytes", "lines", "events") else "bigint").alias(c) for c in a.columns if c != "file"]
    return a.select(F.regexp_extract("file", _SHORT, 1).alias("name"), *counts)


@query(_SL + " SELECT name, sum(strlen(value))::BIGINT AS length, sha256(string_agg(value, '' ORDER BY event_id)) AS sha256 FROM sl GROUP BY name")
def src_log_digest(spark, sf):
    return files.file_digests(spark, _server_files(spark, sf)).select(F.regexp_extract("path", _SHORT, 1).alias("name"), "length", "sha256")


@query("SELECT 'heap ' || event_id % 3 AS detail, 'oom' AS kind, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL")
def fn_markers(spark, sf):
    d = server_lines(spark, sf).select(F.inline(server_log.markers_of(F.split("value", "\n"))))
    return d.groupBy("kind", "detail").agg(F.count("*").alias("n"))


@query("SELECT event_id, 'com.acme.Shop' AS class_name, 'pay' AS method, 'Shop.java' AS file, 42 AS line FROM events WHERE event_type = 'error'")
def fn_frame(spark, sf):
    return server_lines(spark, sf).select("event_id", F.inline(server_log.frames_of(F.split("value", "\n"))))


@query(_ML + " SELECT event_id, CASE form WHEN 1 THEN NULL WHEN 3 THEN lower(level) ELSE level END AS level, CASE WHEN form <> 1 THEN 'exec-1' END AS thread, CASE WHEN form <> 2 THEN strftime(ts, '%Y-%m-%d') END AS day FROM ml")
def fn_log_header(spark, sf):
    d = mixed_lines(spark, sf).select("event_id", server_log.header(F.substring_index("value", "\n", 1)).alias("h"))
    return d.select("event_id", "h.level", "h.thread", F.substring("h.raw_timestamp", 1, 10).alias("day"))


@query("SELECT event_id, event_type = 'error' AS stack FROM events")
def fn_has_stack(spark, sf):
    d = server_lines(spark, sf).withColumn("l", F.split("value", "\n"))
    return d.select("event_id", F.coalesce(T.has_stack(F.slice("l", 2, 10)), F.lit(False)).alias("stack"))


@query("WITH " + PE._GCL + " SELECT CASE form WHEN 0 THEN 'young' WHEN 2 THEN 'full' ELSE 'other' END AS phase, count(*) AS n FROM gl WHERE form < 3 GROUP BY ALL")
def src_gc_log(spark, sf):
    d = PE.gc_lines(spark, sf).select(F.col("line").alias("value")).repartition(3)
    lines = S.read_lines(spark, _written(d, spark)).withColumnRenamed("file", "log")
    return G.events(lines).groupBy("phase").agg(F.count("*").alias("n"))


@query("WITH " + PE._GCL + " SELECT line_no, CASE WHEN form IN (0, 2) THEN CASE form WHEN 0 THEN 3 ELSE 7 END WHEN form = 3 THEN 9 END AS gc_id, form < 3 AS sized FROM gl")
def fn_gc_fields(spark, sf):
    return PE.gc_lines(spark, sf).select("line_no", T.gc_fields(F.col("line")).alias("f")).select("line_no", "f.gc_id", F.col("f.before_mb").isNotNull().alias("sized"))


def dump_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(
        F.lit('"'), F.col("c_name"), F.lit('" #'), k.cast("string"), F.lit(" prio=5 cpu=1.50ms elapsed=2.00s tid=0x"), F.lower(F.hex("c_custkey")), F.lit(" nid=0x1 runnable\n   java.lang.Thread.State: "),
        F.when(k % 2 == 0, "BLOCKED (on object monitor)").otherwise("RUNNABLE"), F.lit("\n\tat com.acme.S"), F.col("c_nationkey").cast("string"), F.lit(".run(S.java:7)\n\t- "), F.when(k % 2 == 0, "waiting to lock").otherwise("locked"), F.lit(" <0x"), F.lower(F.hex(F.col("c_custkey") - F.col("c_custkey") % 2)), F.lit("> (a java.lang.Object)\n"),
    )
    return table(spark, sf, "customer").select("c_custkey", text.alias("value"))


@query("SELECT c_name AS name, '0x' || lower(to_hex(c_custkey)) AS tid, CASE WHEN c_custkey % 2 = 0 THEN 'BLOCKED' ELSE 'RUNNABLE' END AS state, 1.5::DOUBLE AS cpu_ms, 'com.acme.S' || c_nationkey || '.run' AS top, CASE WHEN c_custkey % 2 = 0 THEN '0x' || lower(to_hex(c_custkey)) END AS waits_for FROM customer")
def td_parse(spark, sf):
    d = dump_lines(spark, sf).repartitionByRange("c_custkey").sortWithinPartitions("c_custkey").select("value")
    t = thread_dump.threads(S.read_lines(spark, _written(d, spark)))
    return t.select("name", "tid", "state", "cpu_ms", F.col("stack")[0].alias("top"), "waits_for")


@query("SELECT 'w' || c_custkey AS waiter, 'h' || c_nationkey AS holder FROM customer")
def td_deadlock_text(spark, sf):
    k = F.col("c_custkey").cast("string")
    v = F.concat(F.lit('"w'), k, F.lit('":\n  waiting to lock monitor 0x01 (object 0x02, a X),\n  which is held by "h'), F.col("c_nationkey").cast("string"), F.lit('"'))
    body = table(spark, sf, "customer").select(v.alias("value"))
    head = spark.range(1).select(F.lit("Found one Java-level deadlock:").alias("value"))
    d = thread_dump.reported_deadlocks(S.read_lines(spark, _written(head.unionByName(body).coalesce(1), spark)))
    return d.select("waiter", "holder")


@query("SELECT 'q' || s_suppkey AS query_digest, s_suppkey AS calls FROM supplier")
def src_db_snapshot(spark, sf):
    one = table(spark, sf, "supplier").select(F.struct(F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("query_digest"), F.col("s_suppkey").alias("calls")).alias("q"))
    doc = one.groupBy().agg(F.collect_list("q").alias("queries")).select(F.to_json(F.struct("queries")).alias("value"))
    return snapshots.read_snapshot(spark, _written(doc, spark))["queries"].select("query_digest", "calls")


@query("SELECT p_type AS kind_name, count(*) AS n FROM part GROUP BY ALL")
def src_ddl(spark, sf):
    d = table(spark, sf, "part").select(F.concat(F.lit("CREATE TABLE IF NOT EXISTS "), F.col("p_type"), F.lit(" (x int); -- CREATE VIEW no")).alias("value"))
    return snapshots.read_ddl(spark, _written(d, spark)).groupBy(F.col("name").alias("kind_name")).agg(F.count("*").alias("n"))


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    src = F.concat(F.lit("package com.acme;\nimport com.other.Util;\n// class No\npublic class C"), k, F.lit(" {\n  public void run"), k, F.lit("(int a) { new Util(); }\n}"))
    return p.select(F.concat(F.lit("/src/C"), k, F.lit(".java")).alias("path"), src.alias("source"))


@query("SELECT '/src/C' || p_partkey || '.java' AS path, unnest(['type', 'method']) AS kind, unnest(['C' || p_partkey, 'run' || p_partkey]) AS name FROM part")
def src_symbols(spark, sf):
    return snapshots.symbols(_sources(spark, sf)).select("path", "kind", "name")


@query("SELECT '/src/C' || p_partkey || '.java' AS path, 'com.other.Util' AS class_name, 'new' AS kind FROM part")
def src_refs(spark, sf):
    return snapshots.references(_sources(spark, sf), spark.createDataFrame([("com.other.Util",), ("com.acme.Missing",)], "class_name string"))


@query("SELECT 'com.acme.C' || p_partkey AS class_name, '/src/C' || p_partkey || '.java' AS path FROM part")
def src_lookup(spark, sf):
    names = table(spark, sf, "part").select(F.concat(F.lit("com.acme.C"), F.col("p_partkey").cast("string")).alias("class_name"))
    return snapshots.lookup(snapshots.symbols(_sources(spark, sf)), names)


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'shop.war' WHEN 1 THEN 'lib.jar' END AS artifact FROM part")
def fn_artifact_of(spark, sf):
    k = F.col("p_partkey") % 3
    url = F.when(k == 0, "file:/srv/apps/shop.war/WEB-INF/classes/").when(k == 1, "jar:file:/x/lib.jar!/a").otherwise("file:/opt/classes/")
    return table(spark, sf, "part").select("p_partkey", E.artifact_of(url).alias("artifact"))


@query("SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AND o_orderkey % 10 <= 5 AS compatible, CASE WHEN o_orderkey % 3 = 0 THEN 'process' WHEN o_orderkey % 10 > 5 THEN 'time' END AS reason, o_orderkey % 2 = 0 AS limited FROM orders")
def x_compat(spark, sf):
    k, at = F.col("o_orderkey"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    d = table(spark, sf, "orders").select(k.alias("id"), F.lit("p1").alias("a_process"), F.when(k % 3 == 0, "p2").otherwise("p1").alias("b_process"), F.lit("b").alias("a_build"), F.lit(None).cast("string").alias("b_build"), at.alias("a_at"), F.timestamp_seconds(F.unix_seconds(at) + k % 10 * 60).alias("b_at"), (k % 2 == 0).alias("partial"))
    return E.compatible(d)


@query("SELECT 'com.acme.S' || c_nationkey AS class_name, '/S' || c_nationkey AS path, 'run' AS method, count(*) AS threads FROM customer GROUP BY ALL")
def x_allocator(spark, sf):
    f = table(spark, sf, "customer").select(F.col("c_name").alias("thread"), F.concat(F.lit("/S"), F.col("c_nationkey").cast("string")).alias("path"), F.lit("run").alias("method"))
    r = table(spark, sf, "nation").select(F.concat(F.lit("/S"), F.col("n_nationkey").cast("string")).alias("path"), F.lit("run").alias("method"), F.concat(F.lit("com.acme.S"), F.col("n_nationkey").cast("string")).alias("class_name"))
    return E.allocators(r, f)


@query("SELECT 'class' AS kind, 'com.acme.T' || p_size AS name, 'histogram' AS origin FROM part GROUP BY p_size UNION ALL SELECT 'class', 'com.acme.S' || n_nationkey, 'frame' FROM nation UNION ALL (SELECT 'thread', c_name, 'dump' FROM customer ORDER BY c_name LIMIT 400)")
def x_incident_evidence(spark, sf):
    h = table(spark, sf, "part").groupBy("p_size").agg(F.sum("p_partkey").alias("bytes")).select(F.concat(F.lit("com.acme.T"), F.col("p_size").cast("string"), F.lit("$1")).alias("class_name"), "bytes")
    f = table(spark, sf, "nation").select(F.concat(F.lit("com.acme.S"), F.col("n_nationkey").cast("string")).alias("class_name"))
    return E.incident_evidence(h, f, table(spark, sf, "customer").select(F.col("c_name").alias("thread")))


@query("SELECT p_partkey, p_brand = (SELECT min(p_brand) FROM part) AS verified FROM part")
def x_build_verified(spark, sf):
    p = table(spark, sf, "part")
    m = p.agg(F.min("p_brand").alias("build_id")).withColumn("valid", F.lit(True))
    return E.build_verified(p.select("p_partkey", F.col("p_brand").alias("build_id")), m).select("p_partkey", "verified")


@query("WITH " + PE.TH_SQL + " SELECT name FROM t WHERE k % 6 = 3")
def x_db_thread(spark, sf):
    return E.database_threads(PE.thread_table(spark, sf), True, 120).select("name")


@query("WITH d AS (SELECT o_orderpriority AS list, o_orderkey AS name, o_orderkey % 7 = 0 AS affected, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey % 7 = 0 DESC, o_orderkey) AS place FROM orders), e AS (SELECT *, sum(10) OVER (ORDER BY place, list) AS upto FROM d WHERE place <= 80) SELECT list, name, place FROM e WHERE upto <= 1500")
def llm_trim(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("list"), F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 7 == 0).alias("affected"), F.lit(10).alias("size"))
    return E.trimmed(d, 1500).select("list", "name", "place")


@query("WITH t AS (SELECT c_custkey AS k, c_mktsegment AS finding, c_name AS thread FROM customer), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY finding ORDER BY thread) <= 12) SELECT DISTINCT finding, CASE WHEN k % 3 = 0 THEN 'java.util.Lock' ELSE 'com.acme.W' || k % 4 END AS class_name, 'm' AS method, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS line FROM f")
def td_locations(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    frames = F.array(F.struct(F.lit(0).alias("pos"), F.lit("java.util.Lock").alias("class_name"), F.lit("m").alias("method"), F.lit(0).alias("line"), (k % 3 == 0).alias("is_lock")), F.struct(F.lit(1).alias("pos"), F.concat(F.lit("com.acme.W"), (k % 4).cast("string")).alias("class_name"), F.lit("m").alias("method"), F.lit(1).alias("line"), F.lit(False).alias("is_lock")))
    a = c.select(F.col("c_mktsegment").alias("finding"), F.col("c_name").alias("thread"), F.inline(frames))
    return E.locations(a, spark.createDataFrame([("com.acme.W1",)], "class_name string"))


@query("WITH RECURSIVE " + PH.HEAP_SQL + " SELECT 'C' || c_custkey AS thread, 0 AS pos, 'run' AS method, count(o_orderkey) AS locals, coalesce(sum(24 + o_orderkey % 8 * 8), 0)::BIGINT AS local_bytes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def hp_threads(spark, sf):
    r = table(spark, sf, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("node"), F.lit("java_frame").alias("kind"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("thread"), F.lit(0).alias("frame"))
    t = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("thread"), F.lit(0).alias("pos"), F.lit("run").alias("method"))
    return E.heap_threads(r, t, PH.objects(spark, sf))


def _retention(spark: SparkSession, sf: str) -> DataFrame:
    o = PH.objects(spark, sf)
    names = o.join(few(PH.classes(spark).select(F.col("cid").alias("class_id"), F.col("name").alias("class_name"))), "class_id").select("oid", "class_name")
    s = table(spark, sf, "supplier").where("s_acctbal >= 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("oid"))
    return E.trace_retention(PH.edges(spark, sf), PH.roots(spark, sf), s, names)


@query("SELECT 'S' || s_suppkey AS sample, 0 AS level, 'field' AS kind, 'N' || s_nationkey AS holder, 'Nation.suppliers' AS field FROM supplier WHERE s_acctbal >= 0")
def hp_trace_retention(spark, sf):
    return _retention(spark, sf).select("sample", "level", "kind", "holder", "field")


@query("SELECT 'S' || s_suppkey AS sample, 'com.acme.stock.Supplier > Nation.suppliers' AS path, 'S' || s_suppkey || ' < N' || s_nationkey AS objects, false AS partial FROM supplier WHERE s_acctbal >= 0")
def hp_retention_paths(spark, sf):
    return _retention(spark, sf).select("sample", F.array_join("path", " > ").alias("path"), F.array_join("objects", " < ").alias("objects"), "partial")


@query("SELECT 'P' || p_partkey AS oid, 8 AS length FROM part WHERE p_size % 2 = 0")
def hp_waste_constant(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("oid"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))).alias("sample"), F.lit(8).alias("length"))
    return E.constant_arrays(p)


@query("SELECT '8' AS etype, count(*) AS arrays, count(DISTINCT sha256(text)) AS digests FROM documents WHERE text IS NOT NULL")
def hp_hashes(spark, sf):
    return PH._hashes(spark, sf).agg(F.first(F.col("etype").cast("string")).alias("etype"), F.count("*").alias("arrays"), F.countDistinct("digest").alias("digests"))


_TOLD = """, ran AS (SELECT f.flow_key, f.ep, count(*) AS n, min(rank) AS rank FROM f LEFT JOIN rk ON rk.signature = f.signature AND rk.type = f.type AND rk.index = f.index AND rk.site IS NOT DISTINCT FROM f.site AND rk.expected IS NOT DISTINCT FROM f.expected GROUP BY ALL)
SELECT m.flow_key AS thread_id, m.start_ms AS at_ms, m.ep, ran.rank,
  CASE WHEN m.size < 10 THEN 'under-sampled cluster' WHEN censored IS NULL THEN 'outside the evaluation window' WHEN censored THEN 'censored' WHEN n IS NULL THEN 'no finding' WHEN ran.rank IS NULL THEN 'suppressed' WHEN ran.rank <= 20 THEN 'reported' ELSE 'ranked too low' END AS outcome
FROM m LEFT JOIN judged j ON j.flow_key = m.flow_key AND j.ep = m.ep LEFT JOIN ran ON ran.flow_key = m.flow_key AND ran.ep = m.ep"""


@query("WITH " + RANKING_SQL + _TOLD)
def val_explain(spark, sf):
    """Asked at the start of every episode."""
    from emberlens.operators import detect as D

    members = PF._members(spark, sf)
    found = PF._stored_findings(members)
    located = R.locate(members, members.select("thread_id", F.col("start_ms").alias("at_ms")))
    return E.explain(located, D.judged(members, PF.RULED), found, PF._ranking(spark, sf, found), EVENTS_CONFIG.top_n, members.select("flow_key", "ep", "under_sampled"))


@query("WITH " + RANKING_SQL + " SELECT rank, type, signature, occurrences, round(score, 6) AS score FROM rk WHERE rank <= 20")
def sink_report_json(spark, sf):
    """The report, read again."""
    text = spark.createDataFrame([(snapshots.report_json(PF._ranking(spark, sf)),)], "json string")
    found = F.from_json("json", "struct<findings: array<struct<rank: int, type: string, signature: string, occurrences: bigint, score: double>>>")["findings"]
    return text.select(F.inline(found))


@query("SELECT 'queries' AS section, 'available' AS status, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS rows, '' AS lacking UNION ALL SELECT 'tables', 'partial', (SELECT count(*) FROM part), 'owner' UNION ALL SELECT 'indexes', 'missing', NULL, 'name' UNION ALL SELECT 'sessions', 'available', (SELECT count(*) FROM customer), '' UNION ALL SELECT 'settings', 'empty', 0, ''")
def db_coverage(spark, sf):
    from emberlens.operators import db
    from emberlens.plans import db as PD

    people = table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    sections = {"queries": PD.statements(spark, sf), "tables": PD.tables(spark, sf), "sessions": people, "settings": people.where("name is null")}
    return db.coverage_table(sections, {"queries": ("calls",), "tables": ("name", "owner"), "indexes": ("name",), "sessions": ("name",), "settings": ("name",)})


_NAMES = "[" + ", ".join(f"'{k}'" for k in synthetic.SHAPES) + "]"


def _draw_sql(kind: int, counter: str) -> str:
    """The generator's draw in SQL."""
    x = str(7_919 + kind * 104_729)
    for c in (counter, str(kind)):
        x = f"(SELECT xor(x, x >> 15) FROM (SELECT (({x})::BIGINT + {c}) * {synthetic.FACTOR} % {synthetic.MODULUS} AS x))"
    return f"({x} >> 12)"


@query(
    f"""WITH k AS (SELECT count(*) AS m FROM events), e AS (
  SELECT n, {_draw_sql(1, 'n')} % 5 AS s, {_draw_sql(2, 'n')} % 50 AS rare, {_draw_sql(3, 'n')} % 3 AS kind, m FROM (SELECT unnest(range(m)) AS n, m FROM k)),
p AS (SELECT {_NAMES}[s + 1] AS shape, CASE WHEN n >= 16 AND n < m - 16 - m % 16 AND rare = 0 THEN ['TRUNCATION', 'DIVERGENCE', 'TIMING'][kind + 1] END AS type FROM e)
SELECT shape, type, count(*) AS planted, count(*) AS found, 0 AS beside FROM p WHERE type IS NOT NULL GROUP BY ALL"""
)
def src_synthetic(spark, sf):
    """Of flows made from the number of events: defects planted and found for each shape and kind, and findings beside them."""
    s = synthetic.Scenario(table(spark, sf, "events").count())
    c = s.config()
    eps = SEG.episodes(SEG.entry_marker(synthetic.records(spark, s), c.entry_sites, c.terminal_sites))
    # a cluster is one shape, told by its first site
    shape = F.element_at(F.create_map(*[F.lit(x) for k, v in synthetic.SHAPES.items() for x in (v[0], k)]), F.substring_index("signature", " > ", 1))
    found = DET.findings(BASE.clustered(eps, c.signature_k, 1), c, stored=True).select("flow_key", "ep", "type", "index", shape.alias("_shape"), F.lit(1).alias("hit"))
    both = synthetic.truth(spark, s).withColumn("made", F.lit(1)).join(found, ["flow_key", "ep", "type", "index"], "full")
    d = both.groupBy(F.coalesce("shape", "_shape").alias("shape"), "type").agg(F.count("made").alias("planted"), F.count_if(F.col("made").isNotNull() & F.col("hit").isNotNull()).alias("found"), F.count_if(F.col("made").isNull()).alias("beside"))
    return d.select("shape", "type", "planted", "found", F.col("beside").cast("int").alias("beside"))


# ---- files that tasks write into the shared folder


def _dump(rows: pa.Table) -> pa.Table:
    """A heap dump of the customers of one block: nations hold arrays of their customers."""
    import struct

    pairs = sorted(zip(rows["c_nationkey"].to_pylist(), rows["c_custkey"].to_pylist(), strict=True))
    i = lambda x: x.to_bytes(8, "big")
    rec = lambda tag, body: bytes([tag]) + struct.pack(">II", 0, len(body)) + body
    names = {1: b"com/acme/Nation", 2: b"com/acme/Customer", 3: b"customers"}
    out = b"JAVA PROFILE 1.0.2\0" + struct.pack(">IQ", 8, 0) + b"".join(rec(1, i(k) + v) for k, v in names.items())
    out += b"".join(rec(2, struct.pack(">I", c) + i(0x10 * c) + struct.pack(">I", 0) + i(c)) for c in (1, 2))
    heap = b""
    for c, fields in ((1, [(3, 2)]), (2, [])):
        heap += b"\x20" + i(0x10 * c) + struct.pack(">I", 0) + i(0) * 6 + struct.pack(">IHHH", 0, 0, 0, len(fields)) + b"".join(i(n) + bytes([k]) for n, k in fields)
    for n in sorted({n for n, _ in pairs}):
        own = [(1 << 32) + c for m, c in pairs if m == n]
        heap += b"\x21" + i(0x1000 + n) + struct.pack(">I", 0) + i(0x10) + struct.pack(">I", 8) + i(0x3000 + n)
        heap += b"\x22" + i(0x3000 + n) + struct.pack(">II", 0, len(own)) + i(0x20) + b"".join(map(i, own))
        heap += b"\x05" + i(0x1000 + n)
    for _, c in pairs:
        heap += b"\x21" + i((1 << 32) + c) + struct.pack(">I", 0) + i(0x20) + struct.pack(">I", 0)
    return pa.table({"name": [f"block-{rows['k'][0].as_py()}.hprof"], "data": pa.array([out + rec(0x1C, heap) + rec(0x2C, b"")], pa.binary())})


#: Customers of a dump.
DUMPED = 1_000


def customer_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Files (name, data): a heap dump for each block of customers."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_custkey") / DUMPED).alias("k"))
    return c.groupBy("k").applyInArrow(_dump, "name string, data binary")


def _put(spark: SparkSession, made: DataFrame, kind: str) -> str:
    folder = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    files.write_files(made, folder)
    return folder


@query(f"""WITH g AS (SELECT c_custkey // {DUMPED} AS k, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) SELECT 'com.acme.Customer' AS class_name, 'instance' AS kind, sum(n)::BIGINT AS n, (sum(n) * 16)::BIGINT AS bytes FROM g
UNION ALL SELECT 'com.acme.Nation', 'instance', count(*), (count(*) * 16)::BIGINT FROM g UNION ALL SELECT 'com.acme.Customer', 'object_array', count(*), sum(ceil((16 + 4 * n) / 8) * 8)::BIGINT FROM g""")
def src_hprof(spark, sf):
    from emberlens.sources import hprof

    t = hprof.tables_of(hprof.read_dumps(spark, _put(spark, customer_dumps(spark, sf), "dumps")))
    j = t["objects"].where("kind <> 'class'").join(t["classes"].select("dump", F.col("cid").alias("class_id"), F.col("name").alias("class_name")), ["dump", "class_id"])
    return j.groupBy("class_name", "kind").agg(F.count("*").alias("n"), F.sum("shallow").alias("bytes"))


@query("SELECT p_partkey, ['hprof', 'gzip', 'phd', 'javacore', 'system_dump', 'classic', 'unknown'][p_partkey % 7 + 1] AS format FROM part")
def src_heap_format(spark, sf):
    """A part is a file that begins as one of seven kinds and goes on with its name."""
    from emberlens.sources.hprof import heap_formats

    heads = ("JAVA PROFILE 1.0.2\0", "\x1f\x8b\x08", "\0\x14portable heap dump", "0SECTION       TITLE\n1TISIGINFO", "\x7fELF\x02", "// Version: 1", "PK")
    k = F.col("p_partkey")
    head = F.element_at(F.array(*[F.lit(x.encode("latin-1")) for x in heads]), (k % 7 + 1).cast("int"))
    d = table(spark, sf, "part").select(k.alias("path"), F.concat(head, F.encode("p_name", "UTF-8")).alias("content"))
    return heap_formats(d).select(F.col("path").alias("p_partkey"), "format")


@query("SELECT 's' || s_suppkey || ['.java', '.kt', '.scala'][s_suppkey % 3 + 1] AS name, s_name AS word FROM supplier WHERE s_suppkey % 5 < 3")
def src_source_tree(spark, sf):
    """A supplier is a file: of five, one lies in a build folder and one is a text."""
    k = F.col("s_suppkey")
    of = lambda ending: F.concat(F.lit("s"), k.cast("string"), ending)
    ending = F.element_at(F.array(F.lit(".java"), F.lit(".kt"), F.lit(".scala")), (k % 3 + 1).cast("int"))
    name = F.when(k % 5 == 3, F.concat(F.lit("app/build/"), of(ending))).when(k % 5 == 4, F.concat(F.lit("app/"), of(F.lit(".txt")))).otherwise(F.concat(F.lit("app/src/"), of(ending)))
    made = table(spark, sf, "supplier").select(name.alias("name"), F.encode(F.concat(F.lit("// "), "s_name"), "UTF-8").alias("data"))
    d = snapshots.read_sources(spark, _put(spark, made, "sources"))
    return d.select(F.substring_index("path", "/", -1).alias("name"), F.substring("source", 4, 100).alias("word"))


@query("SELECT 'RUNNABLE' AS state, count(*) FILTER (c_custkey % 2 = 1) AS n FROM customer UNION ALL SELECT 'BLOCKED', count(*) FILTER (c_custkey % 2 = 0) FROM customer")
def src_thread_dump(spark, sf):
    d = dump_lines(spark, sf).repartitionByRange("c_custkey").sortWithinPartitions("c_custkey").select("value")
    return thread_dump.threads(S.read_lines(spark, _written(d, spark))).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'java.lang.OutOfMemoryError' END AS exception FROM events")
def fn_exception(spark, sf):
    names = F.regexp_extract_all("value", F.lit(server_log.EXCEPTION), F.lit(1))
    return server_lines(spark, sf).select("event_id", F.when(F.size(names) > 0, F.element_at(names, -1)).alias("exception"))


@query("SELECT event_id, event_type = 'error' AS error FROM events")
def fn_is_error(spark, sf):
    return server_lines(spark, sf).select("event_id", T.is_error(F.col("value")).alias("error"))


@query("WITH " + PE._GCL + " SELECT line_no, CASE form WHEN 0 THEN 12.0 WHEN 1 THEN ('1.' || c)::DOUBLE ELSE (a || '.5')::DOUBLE END AS ts_s FROM gl WHERE form < 3")
def fn_gc_ts(spark, sf):
    d = PE.gc_lines(spark, sf)
    one = d.withColumn("log", F.col("line_no").cast("string"))
    return G.events(one).select(F.col("log").cast("bigint").alias("line_no"), "ts_s")


@query("SELECT '/C' || p_partkey || '.java' AS path, unnest(CASE p_partkey % 3 WHEN 0 THEN ['put', 'null assignment'] WHEN 1 THEN ['clear', 'assignment'] ELSE ['get'] END) AS operation, unnest(CASE p_partkey % 3 WHEN 0 THEN ['candidate_write', 'candidate_cleanup'] WHEN 1 THEN ['candidate_cleanup', 'candidate_write'] ELSE ['other_usage'] END) AS category FROM part")
def src_field_ops(spark, sf):
    k, n = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    use = F.when(k == 0, "cache.put(a, b);\n    this.cache = null;").when(k == 1, "cache.clear(); // cache.put(1)\n    cache = make();").otherwise("cache.get(a); String t = \"cache.put(x)\";")
    source = F.concat(F.lit("class C"), n, F.lit(" {\n  private Map<String, String> cache = null;\n  void run(String a) {\n    "), use, F.lit("\n  }\n}"))
    d = table(spark, sf, "part").select(F.concat(F.lit("/C"), n, F.lit(".java")).alias("path"), source.alias("source"))
    return snapshots.field_operations(d).select("path", "operation", "category")


@query("SELECT p_partkey, p_brand FROM part")
def sink_artifact(spark, sf):
    folder, parts = f"{shared_dir(spark)}/artifacts-{uuid.uuid4().hex}", table(spark, sf, "part")
    artifacts.write_artifact(parts.select("p_partkey"), folder, "parts")
    artifacts.write_artifact(parts.select("p_partkey", "p_brand"), folder, "parts")
    artifacts.vacuum(spark, folder, "parts")
    return artifacts.read_artifact(spark, folder, "parts")


@query(
    "WITH "
    + RECORDS_SQL
    + """, a AS (SELECT *, sum((call_site = 'view')::INT) OVER (PARTITION BY flow_key ORDER BY ts_ms, event_id)::BIGINT AS ep FROM r),
b AS (SELECT *, coalesce(sum((call_site IN ('purchase', 'error'))::INT) OVER (PARTITION BY flow_key, ep ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM a WHERE ep > 0)
SELECT flow_key, count(DISTINCT ep) AS episodes, count(*) AS n_records FROM b WHERE done = 0 GROUP BY flow_key"""
)
def src_yaml_config(spark, sf):
    """Events segmented as a configuration document says."""
    from emberlens.config import FlowConfig

    c = FlowConfig.from_mapping({"segmentation": {"strategy": "entry", "entryCallSites": ["view"], "terminalCallSites": ["purchase", "error"], "idleGapMillis": 43_200_000}, "clustering": {"signatureK": 2}})
    d = SEG.episodes(SEG.entry_marker(PF._records(spark, sf), c.entry_sites, c.terminal_sites))
    return d.groupBy("flow_key").agg(F.count("*").alias("episodes"), F.sum("n_records").alias("n_records"))


@query("SELECT 'dominators' AS stage, CASE WHEN n > 1000 THEN 'skipped' ELSE 'run' END AS status, CASE WHEN n > 1000 THEN n || ' objects, the limit is 1000' END AS reason FROM (SELECT count(*) AS n FROM customer) UNION ALL SELECT 'waste', 'run', NULL")
def hp_gating(spark, sf):
    from emberlens.operators import heap as H

    return H.stages_of(table(spark, sf, "customer"), {"dominators": 1000, "waste": None})


@query("SELECT 'C' || o_custkey AS oid, 'O' || o_orderkey AS node, 'K' || o_orderkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN 'V' || o_orderkey END AS value FROM orders")
def hp_map_entries(spark, sf):
    """A customer is a map of four buckets, its orders are the nodes."""
    from pyspark.sql import Window

    from emberlens.operators import heap as H

    name = lambda x, c: F.concat(F.lit(x), F.col(c).cast("string"))
    chain = Window.partitionBy("o_custkey", F.col("o_orderkey") % 4).orderBy("o_orderkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(chain).alias("before"))
    node = name("O", "o_orderkey")
    e = o.select(F.coalesce(name("O", "before"), name("T", "o_custkey")).alias("src"), node.alias("dst"), F.when(F.col("before").isNull(), F.concat(F.lit("["), (F.col("o_orderkey") % 4).cast("string"), F.lit("]"))).otherwise(H.NEXT[0]).alias("field"))
    e = e.unionByName(o.select(node.alias("src"), name("K", "o_orderkey").alias("dst"), F.lit(H.KEY[0]).alias("field"))).unionByName(o.where("o_orderkey % 3 > 0").select(node.alias("src"), name("V", "o_orderkey").alias("dst"), F.lit(H.VALUE[0]).alias("field")))
    maps = o.groupBy("o_custkey").agg(F.count("*").alias("size")).select(name("C", "o_custkey").alias("oid"), name("T", "o_custkey").alias("table_oid"), "size")
    return H.map_entries(maps, e)


_FIELDS = "package com.acme;\nclass A {\n  private static final java.util.Map<String, Integer> cache = null;\n  protected int size;\n  // private int no;\n  void run(int a) {\n    if (a > 0) {\n      go();\n    }\n  }\n  void go() { }\n}"


def _fixed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.concat(F.lit("/A"), F.col("n_nationkey").cast("string")).alias("path"), F.lit(_FIELDS).alias("source"))


@query("SELECT '/A' || n_nationkey AS path, unnest(['cache', 'size']) AS field FROM nation")
def src_field(spark, sf):
    return snapshots.fields(_fixed(spark, sf)).select("path", "field")


@query("SELECT '/A' || n_nationkey AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'run' ELSE 'size' END AS method, 6 AS first_line, 5 AS lines FROM nation WHERE n_nationkey % 2 = 0")
def src_context(spark, sf):
    k = F.col("n_nationkey")
    w = table(spark, sf, "nation").select(F.concat(F.lit("/A"), k.cast("string")).alias("path"), F.when(k % 2 == 0, "run").otherwise("size").alias("method"))
    return snapshots.method_context(_fixed(spark, sf), w).select("path", "method", "first_line", F.size(F.split("body", "\n")).alias("lines"))


@query("SELECT p_partkey, p_name AS value FROM part")
def fn_display_value(spark, sf):
    wide = F.col("p_partkey") % 2
    sample = F.when(wide == 1, F.hex(F.encode("p_name", "UTF-16LE"))).otherwise(F.hex(F.encode("p_name", "ISO-8859-1")))
    return table(spark, sf, "part").select("p_partkey", snapshots.display_value(sample, wide).alias("value"))


@query("WITH " + RANKING_SQL + " SELECT string_agg(printf('%3d. [%s] %s: at %s expected %s x%d score %.6f', rank, type, signature, coalesce(site, 'None'), coalesce(expected, 'None'), occurrences, round(score, 9)), chr(10) ORDER BY rank) AS text FROM rk WHERE rank <= 20")
def sink_report_text(spark, sf):
    return spark.createDataFrame([(snapshots.report_text(PF._ranking(spark, sf)),)], "text string")
