"""Queries of GC, log, thread, heap and incident analytics over tables that stand in for evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.operators import search_index as XI
from emberlens.operators import gc as G
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


# ---- GC: orders of one priority are a log, a price is the heap before, half the next price what is left


def gc_table(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf, "orders").withColumn("t", F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6)
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    phase = F.when(F.col("o_orderkey") % 11 == 0, "full").when(F.col("o_orderkey") % 5 == 0, "mixed").when(F.col("o_orderkey") % 7 == 0, "concurrent").otherwise("young")
    return o.select(
        F.col("o_orderpriority").alias("log"),
        (F.row_number().over(w) - 1).alias("seq"),
        F.col("t").alias("ts_s"),
        F.col("o_orderkey").alias("gc_id"),
        phase.alias("phase"),
        F.lit("").alias("cause"),
        (F.floor("o_totalprice") / 1024).alias("before_mb"),
        (F.floor(F.col("o_totalprice") / 2) / 1024).alias("after_mb"),
        F.lit(512.0).alias("total_mb"),
        (F.col("o_orderkey") % 97 / 4).alias("pause_ms"),
    )


GC_SQL = """ev AS (SELECT o_orderpriority AS log, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS seq, epoch_us(o_orderdate::TIMESTAMP) / 1e6::DOUBLE AS ts_s,
  CASE WHEN o_orderkey % 11 = 0 THEN 'full' WHEN o_orderkey % 5 = 0 THEN 'mixed' WHEN o_orderkey % 7 = 0 THEN 'concurrent' ELSE 'young' END AS phase,
  floor(o_totalprice) / 1024 AS before_mb, floor(o_totalprice / 2) / 1024 AS after_mb, o_orderkey % 97 / 4 AS pause_ms FROM orders),
sz AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY seq) AS i, count(*) OVER (PARTITION BY log) AS n, lag(after_mb) OVER (PARTITION BY log ORDER BY seq) AS prev FROM ev WHERE phase IN ('young', 'mixed', 'full')),
du AS (SELECT log, count(*) AS gc_count, count(*) FILTER (phase = 'full') AS full_count, max(ts_s) - min(ts_s) AS duration_s FROM ev GROUP BY log),
pa AS (SELECT log, count(*) AS n_pauses, sum(pause_ms) AS total_ms, quantile_cont(pause_ms, 0.5) AS p50_ms, quantile_cont(pause_ms, 0.95) AS p95_ms, quantile_cont(pause_ms, 0.99) AS p99_ms, max(pause_ms) AS max_ms FROM ev WHERE pause_ms > 0 GROUP BY log),
al AS (SELECT log, sum(greatest(before_mb - prev, 0)) AS alloc_mb FROM sz GROUP BY log),
tr AS (SELECT log, regr_slope(after_mb, ts_s) * 60 AS trend FROM sz GROUP BY log),
re AS (SELECT log, n, min(after_mb) FILTER (i <= greatest(2, n // 4)) AS early, min(after_mb) FILTER (i > n - greatest(2, n // 4)) AS late FROM sz GROUP BY log, n)"""


_LINES = [
    "[12.000s][info][gc] GC(3) Pause Young (Normal) (G1 Evacuation Pause) {a}M->{b}M(512M) {c}.5ms",
    "2024-01-01T00:00:00.100+0000: 1.{c}: [GC (Allocation Failure) {a}K->{b}K(128M), 0.00{c} secs]",
    "[{a}.5s][info][gc] GC(7) Pause Full (Ergonomics) {a}M->{b}M(512M) 1{c}.25ms",
    "[3.0s][info][gc] GC(9) Pause Mark Start 0.0{c}ms",
    "application line without collection",
]


def gc_lines(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    fill = lambda s: F.concat(*[{"{a}": (k % 300 + 20).cast("string"), "{b}": (k % 300 + 1).cast("string"), "{c}": (k % 8 + 1).cast("string")}.get(x, F.lit(x)) for x in _split(s)])
    line = fill(_LINES[-1])
    for i in range(len(_LINES) - 2, -1, -1):
        line = F.when(k % len(_LINES) == i, fill(_LINES[i])).otherwise(line)
    return o.select(F.col("o_orderpriority").alias("log"), k.alias("line_no"), line.alias("line"))


def _split(s: str) -> list[str]:
    import re

    return [x for x in re.split(r"(\{[abc]\})", s) if x]


_GCL = (
    "gl AS (SELECT o_orderpriority AS log, o_orderkey AS line_no, o_orderkey % 5 AS form, (o_orderkey % 300 + 20)::VARCHAR AS a, (o_orderkey % 300 + 1)::VARCHAR AS b, (o_orderkey % 8 + 1)::VARCHAR AS c FROM orders)"
)


@query(
    "WITH "
    + _GCL
    + """ SELECT log, row_number() OVER (PARTITION BY log ORDER BY line_no) - 1 AS seq, CASE form WHEN 0 THEN 12.0 WHEN 1 THEN ('1.' || c)::DOUBLE ELSE (a || '.5')::DOUBLE END AS ts_s,
 CASE form WHEN 0 THEN 3 WHEN 2 THEN 7 ELSE row_number() OVER (PARTITION BY log ORDER BY line_no) - 1 END AS gc_id, CASE form WHEN 0 THEN 'young' WHEN 2 THEN 'full' ELSE 'other' END AS phase,
 CASE form WHEN 0 THEN 'G1 Evacuation Pause' WHEN 1 THEN 'Allocation Failure' ELSE 'Ergonomics' END AS cause, CASE form WHEN 1 THEN a::DOUBLE / 1024 ELSE a::DOUBLE END AS before_mb, CASE form WHEN 1 THEN b::DOUBLE / 1024 ELSE b::DOUBLE END AS after_mb,
 CASE form WHEN 1 THEN 128.0 ELSE 512.0 END AS total_mb, round(CASE form WHEN 0 THEN (c || '.5')::DOUBLE WHEN 1 THEN ('0.00' || c)::DOUBLE * 1000 ELSE ('1' || c || '.25')::DOUBLE END, 6) AS pause_ms FROM gl WHERE form < 3"""
)
def gc_events(spark, sf):
    return G.events(gc_lines(spark, sf)).withColumn("pause_ms", F.round("pause_ms", 6))


@query("WITH " + _GCL + " SELECT log, CASE WHEN bool_or(form = 0) THEN 'G1' ELSE 'Unknown' END AS collector, CASE WHEN bool_or(form IN (0, 2, 3)) THEN 'unified' ELSE 'legacy' END AS logging FROM gl WHERE line_no <= 200 GROUP BY log")
def gc_collector(spark, sf):
    return G.collector(gc_lines(spark, sf)).drop("sample_stalls")


_GC = "WITH " + GC_SQL


@query(_GC + " SELECT log, n_pauses, total_ms, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, round(p99_ms, 6) AS p99_ms, max_ms FROM pa")
def gc_pauses(spark, sf):
    p = G.pauses(gc_table(spark, sf))
    return p.select("log", "n_pauses", "total_ms", *[F.round(c, 6).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")], "max_ms")


@query(_GC + " SELECT log, duration_s, round(greatest(0, least(100, (duration_s * 1000 - total_ms) / (duration_s * 1000) * 100)), 6) AS throughput_pct FROM du JOIN pa USING (log)")
def gc_throughput(spark, sf):
    return G.throughput(gc_table(spark, sf)).withColumn("throughput_pct", F.round("throughput_pct", 6))


@query(_GC + " SELECT log, round(alloc_mb, 4) AS alloc_mb FROM al")
def gc_alloc_rate(spark, sf):
    return G.allocation(gc_table(spark, sf)).withColumn("alloc_mb", F.round("alloc_mb", 4))


@query(_GC + " SELECT log, round(trend, 9) AS trend_mb_min FROM tr")
def gc_trend(spark, sf):
    return G.trend(gc_table(spark, sf)).withColumn("trend_mb_min", F.round("trend_mb_min", 9))


@query(_GC + " SELECT log, n < 8 OR late <= early * 1.5 OR (late - early) / greatest(early, 1.0) < 0.5 AS reset FROM re")
def gc_baseline_reset(spark, sf):
    return G.baseline_reset(gc_table(spark, sf)).select("log", "reset")


@query(_GC + ", n AS (SELECT log, count(*) AS n FROM ev GROUP BY log), k AS (SELECT log, n, unnest(range(0, 400)) AS k FROM n), p AS (SELECT log, floor(k * (n / 400))::BIGINT AS seq FROM k WHERE n > 400 UNION ALL SELECT log, seq FROM ev JOIN n USING (log) WHERE n <= 400) SELECT DISTINCT log, seq FROM p")
def gc_downsample(spark, sf):
    return G.downsample(gc_table(spark, sf)).select("log", "seq")


_RULES = """f AS (SELECT log, CASE WHEN full_count >= 5 THEN 'critical' WHEN full_count >= 3 THEN 'warning' END AS fg, tp, p99_ms, alloc_mb / duration_s AS ar, trend, n, NOT (n < 8 OR late <= early * 1.5 OR (late - early) / greatest(early, 1.0) < 0.5) AS stuck
  FROM du JOIN (SELECT log, greatest(0, least(100, (duration_s * 1000 - total_ms) / (duration_s * 1000) * 100)) AS tp FROM du JOIN pa USING (log)) USING (log) JOIN pa USING (log) JOIN al USING (log) JOIN tr USING (log) JOIN re USING (log)),
rules AS (SELECT log, 'leak' AS rule, 'critical' AS severity FROM f WHERE trend > 1 AND stuck AND n >= 8 UNION ALL SELECT log, 'full_gc_or_stall', fg FROM f WHERE fg IS NOT NULL
  UNION ALL SELECT log, 'throughput', CASE WHEN tp < 70 THEN 'critical' ELSE 'warning' END FROM f WHERE tp < 90 UNION ALL SELECT log, 'long_pause', 'warning' FROM f WHERE tp >= 90 AND p99_ms > 1000 UNION ALL SELECT log, 'allocation', 'warning' FROM f WHERE ar > 512)"""


@query(_GC + ", " + _RULES + " SELECT * FROM rules")
def gc_findings(spark, sf):
    return G.findings(G.summary(gc_table(spark, sf)))


@query(_GC + ", " + _RULES + " SELECT log, CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN bool_or(severity = 'warning') THEN 'degraded' ELSE 'healthy' END AS verdict FROM rules GROUP BY log")
def verdict(spark, sf):
    return G.verdict(G.findings(G.summary(gc_table(spark, sf))))


# ---- server logs: events are log events, their type and id decide on exceptions, markers and frames

from emberlens.operators import logs as L  # noqa: E402
from emberlens.operators import threads as TD  # noqa: E402

ANCHOR = "2024-01-15 12:00:00"


def log_table(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind, i = F.col("event_type"), F.col("event_id")
    exception = F.when((kind == "error") & (i % 10 == 0), "java.lang.OutOfMemoryError").when(kind == "error", F.concat(F.lit("com.acme.Fail"), (i % 7).cast("string")))
    return e.select(
        i.alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "error", "ERROR").when(kind == "view", "WARN").otherwise("INFO").alias("level"),
        F.col("props").alias("message"),
        exception.alias("exception"),
        F.concat(F.lit("user-"), (F.col("user_id") % 10).cast("string")).alias("thread"),
        F.concat(F.lit("com.acme."), kind).alias("logger"),
        kind.alias("event_type"),
    )


def marker_table(spark: SparkSession, sf: str) -> DataFrame:
    e = log_table(spark, sf)
    i = F.col("id")
    s = lambda n: (i % n).cast("string")
    kind = F.when(F.col("exception").endswith("OutOfMemoryError"), "oom").when((F.col("event_type") == "signup") & (i % 25 == 0), "deploy").when((F.col("event_type") == "purchase") & (i % 40 == 0), "undeploy").when((F.col("event_type") == "click") & (i % 60 == 0), "server_start")
    detail = F.when(kind == "oom", F.concat(F.lit("heap "), s(30))).when(kind == "server_start", "").otherwise(F.concat(F.lit("shop-"), s(4)))
    return e.select(i.alias("event_id"), kind.alias("kind"), detail.alias("detail")).where("kind is not null")


def frame_table(spark: SparkSession, sf: str) -> DataFrame:
    e = log_table(spark, sf).where("level = 'ERROR'")
    f = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("java.util.List").alias("class_name"), F.lit("get").alias("method")),
        F.struct(F.lit(1).alias("pos"), F.concat(F.lit("com.acme.C"), F.floor(F.col("id") % 50 / 10).cast("string")).alias("class_name"), F.lit("run").alias("method")),
    )
    return e.select(F.col("id").alias("event_id"), F.inline(f))


LOG_SQL = """lg AS (SELECT event_id AS id, ts, event_type, props AS message, user_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END AS level,
  CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'java.lang.OutOfMemoryError' WHEN event_type = 'error' THEN 'com.acme.Fail' || event_id % 7 END AS exception FROM events),
mk0 AS (SELECT id AS event_id, ts, CASE WHEN exception LIKE '%OutOfMemoryError' THEN 'oom' WHEN event_type = 'signup' AND id % 25 = 0 THEN 'deploy' WHEN event_type = 'purchase' AND id % 40 = 0 THEN 'undeploy' WHEN event_type = 'click' AND id % 60 = 0 THEN 'server_start' END AS kind FROM lg),
mk AS (SELECT *, CASE kind WHEN 'oom' THEN 'heap ' || event_id % 30 WHEN 'server_start' THEN '' ELSE 'shop-' || event_id % 4 END AS detail FROM mk0 WHERE kind IS NOT NULL)"""
_G = "WITH " + LOG_SQL


@query(_G + " SELECT id, level FROM lg WHERE id > 500 AND level = 'ERROR' AND contains(lower(message), '1') AND ts >= '2024-01-02' AND ts <= '2024-01-20' ORDER BY id LIMIT 51")
def log_search(spark, sf):
    return L.search(log_table(spark, sf), {"level": "ERROR"}, "1", "2024-01-02", "2024-01-20", 500, 50).select("id", "level")


@query(_G + " SELECT id, level FROM lg WHERE id > 500 AND level = 'ERROR' AND contains(lower(message), '\"k\": 1') AND ts >= '2024-01-02' AND ts <= '2024-01-20' ORDER BY id LIMIT 51")
def log_search_indexed(spark, sf):
    """A page of the same kind of search by an index of all events, made first."""
    index = XI.build(log_table(spark, sf))
    return XI.indexed_search(index, spark, '"K": 1', {"level": "ERROR"}, "2024-01-02", "2024-01-20", 500, 50).select("id", "level")


@query(_G + " SELECT id FROM lg WHERE contains(lower(message), '\"k\": 17')")
def log_search_candidates(spark, sf):
    """All events that hold a text: candidates of the index, verified."""
    d = log_table(spark, sf)
    index = XI.build(d)
    found = XI.candidates(index, spark, '"k": 17')
    return index.events(spark).join(found, "id", "left_semi").where(F.lower("message").contains('"k": 17')).select("id")


@query(_G + " SELECT level, count(*) AS n FROM lg GROUP BY level")
def log_levels(spark, sf):
    return L.levels(log_table(spark, sf))


@query(_G + " SELECT exception, count(*) AS n FROM lg WHERE exception IS NOT NULL GROUP BY exception ORDER BY n DESC, exception LIMIT 30")
def log_exceptions(spark, sf):
    return L.exceptions(log_table(spark, sf))


@query(_G + " SELECT detail, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM mk WHERE kind = 'oom' GROUP BY detail ORDER BY n DESC, detail LIMIT 6")
def log_oom_groups(spark, sf):
    return L.oom_groups(marker_table(spark, sf))


@query(_G + ", s AS (SELECT detail, 'com.acme.C' || (event_id % 50) // 10 || '.run' AS frame FROM mk WHERE kind = 'oom' QUALIFY row_number() OVER (PARTITION BY detail ORDER BY event_id DESC) <= 200), c AS (SELECT detail, frame, count(*) AS n FROM s GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY detail ORDER BY n DESC, frame DESC) = 1")
def log_oom_frame(spark, sf):
    return L.oom_frames(marker_table(spark, sf), frame_table(spark, sf))


def captures(spark: SparkSession) -> DataFrame:
    return spark.range(1, 25).select(F.col("id").alias("capture_id"), (F.lit("2024-01-01 06:00:00").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("at"))


_CAP = "cap AS (SELECT range AS capture_id, TIMESTAMP '2024-01-01 06:00:00' + to_days(range::INT) AS at_ts FROM range(1, 25))"


@query(_G + ", " + _CAP + ", j AS (SELECT capture_id, max(ts) FILTER (kind = 'oom' AND ts <= at_ts) AS o, max(ts) FILTER (kind = 'server_start' AND ts < at_ts) AS s FROM cap, mk GROUP BY capture_id) SELECT capture_id, epoch_us(o::TIMESTAMP) AS last_oom_us, coalesce(s > o, false) AS restarted FROM j")
def log_restart(spark, sf):
    r = L.restarts(marker_table(spark, sf), log_table(spark, sf), captures(spark))
    return r.select("capture_id", F.unix_micros("last_oom").alias("last_oom_us"), "restarted")


@query(_G + ", ld AS (SELECT 'shop-' || range AS artifact, range + 1 AS loaders FROM range(6)) SELECT artifact, loaders, count(kind) FILTER (kind = 'deploy') AS deploys, count(kind) FILTER (kind = 'undeploy') AS undeploys, loaders - 1 AS stale FROM ld LEFT JOIN mk ON detail = artifact AND kind IN ('deploy', 'undeploy') GROUP BY ALL")
def log_redeploy(spark, sf):
    loaders = spark.range(6).select(F.concat(F.lit("shop-"), F.col("id").cast("string")).alias("artifact"), (F.col("id") + 1).alias("loaders"))
    return L.redeploys(marker_table(spark, sf), loaders)


_TL = (
    _G
    + """, gr AS (SELECT unnest(range(TIMESTAMP '2024-01-15 10:00:00', TIMESTAMP '2024-01-15 12:20:01', INTERVAL 10 MINUTE)) AS bucket),
n AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts::TIMESTAMP) AS bucket, count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARN') AS warnings FROM lg GROUP BY 1),
m AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts::TIMESTAMP) AS bucket, count(*) AS markers FROM mk GROUP BY 1),
tl AS (SELECT bucket, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(markers, 0) AS markers FROM gr LEFT JOIN n USING (bucket) LEFT JOIN m USING (bucket))"""
)


@query(_TL + " SELECT epoch_us(bucket) // 1000000 AS at, errors, warnings, markers FROM tl")
def log_timeline(spark, sf):
    return L.timeline(log_table(spark, sf), marker_table(spark, sf), ANCHOR).select(F.unix_seconds("bucket").alias("at"), "errors", "warnings", "markers")


@query(_TL + ", k AS (SELECT *, row_number() OVER (ORDER BY bucket DESC) AS k FROM tl), a AS (SELECT avg(errors) FILTER (k <= 3) AS late, avg(errors) FILTER (k > 3) AS early FROM k) SELECT round(late, 9) AS late, round(early, 9) AS early, late >= 5 AND late >= 3 * greatest(early, 1) AS rising FROM a")
def log_error_rise(spark, sf):
    r = L.error_rise(L.timeline(log_table(spark, sf), marker_table(spark, sf), ANCHOR))
    return r.select(F.round("late", 9).alias("late"), F.round("early", 9).alias("early"), "rising")


@query(_G + ", d AS (SELECT id, (epoch_ns(ts) // 1000000000 - epoch_us(TIMESTAMP '2024-01-15 12:00:00') // 1000000) / 60 AS d FROM lg) SELECT id, CASE WHEN abs(d) < 1 THEN 'less than a minute from capture' WHEN d < 0 THEN floor(abs(d) + 0.5)::INT || ' min before capture' ELSE floor(abs(d) + 0.5)::INT || ' min after capture' END AS phrase FROM d")
def log_min_delta(spark, sf):
    return log_table(spark, sf).select("id", L.minutes_phrase(F.col("ts"), F.lit(ANCHOR).cast("timestamp")).alias("phrase"))


_IM = (
    _G
    + ", "
    + _CAP
    + """, hit AS (SELECT id, level, (level = 'ERROR' AND (id % 50) // 10 IN (1, 3))::INT AS by_frame, (event_type IN ('purchase'))::INT AS by_logger, (user_id % 10 = 4)::INT AS by_thread, coalesce(exception LIKE '%OutOfMemoryError', false)::INT AS by_oom,
  EXISTS (SELECT 1 FROM cap WHERE lg.ts BETWEEN at_ts - INTERVAL 30 MINUTE AND at_ts + INTERVAL 30 MINUTE) AS aligned FROM lg),
im AS (SELECT * FROM hit WHERE by_frame + by_logger + by_thread + by_oom > 0 AND aligned)"""
)


def _matches(spark, sf):
    classes = spark.createDataFrame([("com.acme.C1",), ("com.acme.C3",), ("com.acme.purchase",)], "class_name string")
    names = spark.createDataFrame([("user-4",)], "thread string")
    return L.incident_matches(log_table(spark, sf), frame_table(spark, sf), classes, names, captures(spark), 1800)


@query(_IM + " SELECT id, by_frame, by_logger, by_thread, by_oom, aligned FROM im")
def x_incident_match(spark, sf):
    return _matches(spark, sf)


@query(_IM + " SELECT id, by_frame * 4 + by_oom * 3 + by_thread * 2 + by_logger + 2 AS score, CASE level WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END AS severity FROM im ORDER BY score DESC, severity, id LIMIT 100")
def x_incident_rank(spark, sf):
    return L.incident_rank(_matches(spark, sf), log_table(spark, sf))


# ---- thread dumps: a customer is a thread, ten neighbours share a dump and its locks


def thread_table(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    addr = lambda x: F.concat(F.lit("0x"), x.cast("string"))
    waits = F.when(k % 10 <= 2, addr(k + 1)).when((k % 10 == 3) & (k % 20 == 3), addr(k - 3)).when(k % 10 < 4, F.lit(None)).when(k % 10 <= 8, addr(k - k % 10 + 9))
    top = F.when(k % 6 == 3, "com.zaxxer.hikari.pool.HikariPool.getConnection").when(k % 6 == 1, "java.net.SocketInputStream.socketRead0").when(k % 6 == 5, "okhttp3.internal.connection.RealCall.execute")
    top = top.when(k % 6 == 4, "java.util.concurrent.ThreadPoolExecutor.getTask").otherwise("com.acme.Work.step")
    idle = F.when(k % 6 == 3, "WAITING").when(k % 6 == 1, "RUNNABLE").otherwise("TIMED_WAITING")
    return c.select(
        F.concat(F.lit("d"), (F.floor(k / 10) % 5).cast("string")).alias("dump"),
        F.col("c_name").alias("name"),
        k.alias("tid"),
        F.when(waits.isNotNull() & (k % 4 != 1), "BLOCKED").otherwise(idle).alias("state"),
        (k % 2 == 0).alias("daemon"),
        (k % 100 * 100.0).alias("cpu_ms"),
        F.lit(10.0).alias("elapsed_s"),
        F.array(top, F.concat(F.lit("com.acme.S"), F.col("c_nationkey").cast("string"), F.lit(".run")), F.lit("java.lang.Thread.run")).alias("stack"),
        F.array(addr(k)).alias("held"),
        waits.alias("waits_for"),
        (k % 3).cast("int").alias("rejected"),
    )


TH_SQL = """t0 AS (SELECT c_custkey AS k, 'd' || (c_custkey // 10) % 5 AS dump, c_name AS name, c_nationkey, CASE WHEN c_custkey % 10 <= 2 THEN '0x' || (c_custkey + 1) WHEN c_custkey % 20 = 3 THEN '0x' || (c_custkey - 3) WHEN c_custkey % 10 < 4 THEN NULL WHEN c_custkey % 10 <= 8 THEN '0x' || (c_custkey - c_custkey % 10 + 9) END AS waits_for FROM customer),
t AS (SELECT *, CASE WHEN waits_for IS NOT NULL AND k % 4 <> 1 THEN 'BLOCKED' WHEN k % 6 = 3 THEN 'WAITING' WHEN k % 6 = 1 THEN 'RUNNABLE' ELSE 'TIMED_WAITING' END AS state,
  CASE k % 6 WHEN 3 THEN 'com.zaxxer.hikari.pool.HikariPool.getConnection' WHEN 1 THEN 'java.net.SocketInputStream.socketRead0' WHEN 5 THEN 'okhttp3.internal.connection.RealCall.execute' WHEN 4 THEN 'java.util.concurrent.ThreadPoolExecutor.getTask' ELSE 'com.acme.Work.step' END AS top, '0x' || k AS held FROM t0),
sg AS (SELECT dump, sha1(top || '|com.acme.S' || c_nationkey || '.run|java.lang.Thread.run')[1:12] AS signature, count(*) AS n, min(top) AS top FROM t GROUP BY ALL HAVING count(*) >= 2),
ch AS (SELECT w.dump, w.name AS waiter, h.name AS holder, w.waits_for AS address, 'tid:' || w.k AS waiter_id, 'tid:' || h.k AS holder_id FROM t w JOIN t h ON w.dump = h.dump AND w.waits_for = h.held WHERE w.k <> h.k)"""
_T = "WITH RECURSIVE " + TH_SQL


@query(_T + " SELECT dump, state, count(*) AS n, count(*) FILTER (k % 2 = 0) AS daemons FROM t GROUP BY ALL")
def td_states(spark, sf):
    return TD.states(thread_table(spark, sf))


@query(_T + " SELECT * FROM sg")
def td_stack_groups(spark, sf):
    return TD.stack_groups(thread_table(spark, sf)).drop("states")


@query(_T + " SELECT * FROM ch")
def td_blocked_chains(spark, sf):
    return TD.blocked_by(thread_table(spark, sf))


@query(_T + ", w AS (SELECT dump, waiter AS a, waiter AS name, holder AS tip, 1 AS d FROM ch UNION ALL SELECT w.dump, a, w.tip, ch.holder, d + 1 FROM w JOIN ch ON ch.dump = w.dump AND ch.waiter = w.tip WHERE d < 12 AND w.tip <> a), c AS (SELECT DISTINCT dump, a FROM w WHERE tip = a), m AS (SELECT w.dump, w.a, string_agg(DISTINCT w.name, ',' ORDER BY w.name) AS members, min(w.name) AS cycle FROM w JOIN c ON w.dump = c.dump AND w.a = c.a GROUP BY ALL) SELECT DISTINCT dump, cycle, members FROM m")
def td_cycles(spark, sf):
    return TD.deadlocks(TD.blocked_by(thread_table(spark, sf)))


@query(_T + " SELECT dump, waits_for AS address, count(*) AS waiters, CASE WHEN count(*) >= 10 THEN 'critical' ELSE 'warning' END AS severity FROM t WHERE state = 'BLOCKED' AND waits_for IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")
def td_contention(spark, sf):
    return TD.contention(thread_table(spark, sf))


@query(_T + " SELECT dump, count(*) AS waiting FROM t WHERE state IN ('WAITING', 'TIMED_WAITING') AND k % 6 = 3 GROUP BY dump HAVING count(*) >= 5")
def td_db_pool(spark, sf):
    return TD.pool_waits(thread_table(spark, sf), TD.DB_POOL)


@query(_T + " SELECT dump, count(*) AS waiting FROM t WHERE state IN ('WAITING', 'TIMED_WAITING') AND k % 6 = 5 GROUP BY dump HAVING count(*) >= 5")
def td_http_pool(spark, sf):
    return TD.pool_waits(thread_table(spark, sf), TD.HTTP_POOL)


@query(_T + ", tt AS (SELECT dump, count(*) AS total FROM t GROUP BY dump) SELECT dump, signature, n, top, total, row_number() OVER (PARTITION BY dump ORDER BY n DESC, signature) AS rank FROM sg JOIN tt USING (dump) WHERE n >= greatest(5, total * 0.02) QUALIFY rank <= 3")
def td_hotspot(spark, sf):
    return TD.hotspots(thread_table(spark, sf), share=0.02).drop("states")


@query(_T + ", w AS (SELECT dump, waiter, holder AS tip, [waiter, holder] AS path FROM ch UNION ALL SELECT w.dump, w.waiter, ch.holder, list_append(path, ch.holder) FROM w JOIN ch ON ch.dump = w.dump AND ch.waiter = w.tip WHERE NOT list_contains(path, ch.holder)) SELECT dump, waiter, max(len(path)) AS length FROM w GROUP BY ALL")
def td_chain_len(spark, sf):
    return TD.chain_lengths(TD.blocked_by(thread_table(spark, sf)))


@query(_T + ", p AS (SELECT dump, regexp_replace(name, '[0-9]+', '#', 'g') AS pool, count(*) AS n, count(*) FILTER (state = 'RUNNABLE') AS busy, count(*) FILTER (state = 'BLOCKED') AS blocked FROM t GROUP BY ALL HAVING count(*) >= 3), s AS (SELECT dump, regexp_replace(name, '[0-9]+', '#', 'g') AS pool, state, count(*) AS k FROM t GROUP BY ALL), o AS (SELECT dump, pool, state AS mode FROM s QUALIFY row_number() OVER (PARTITION BY dump, pool ORDER BY k DESC, state DESC) = 1) SELECT dump, pool, n, busy, blocked, mode, round(100 * busy / n, 6) AS busy_pct, round(100 * blocked / n, 6) AS blocked_pct, CASE WHEN 100 * blocked / n >= 50 THEN 'saturated' WHEN 100 * busy / n >= 50 THEN 'busy' ELSE 'idle' END AS verdict FROM p JOIN o USING (dump, pool)")
def td_pools(spark, sf):
    return TD.pools(thread_table(spark, sf)).withColumns({c: F.round(c, 6) for c in ("busy_pct", "blocked_pct")})


@query(_T + ", h AS (SELECT dump, name, k % 100 * 100.0::DOUBLE / 10000 * 100 AS cpu_pct FROM t) SELECT dump, name, round(cpu_pct, 6) AS cpu_pct, CASE WHEN cpu_pct >= 60 THEN 'app' END AS finding, row_number() OVER (PARTITION BY dump ORDER BY cpu_pct DESC, name) AS rank FROM h WHERE cpu_pct >= 1 QUALIFY rank <= 10")
def td_hot(spark, sf):
    return TD.hot_threads(thread_table(spark, sf)).withColumn("cpu_pct", F.round("cpu_pct", 6))


@query(_T + " SELECT dump, count(*) AS stuck FROM t WHERE state = 'RUNNABLE' AND k % 6 = 1 GROUP BY dump HAVING count(*) >= 3")
def td_stuck_io(spark, sf):
    return TD.stuck_io(thread_table(spark, sf))


@query(_T + " SELECT dump, count(*) AS threads, count(*) * 3 AS parsed, sum(k % 3)::BIGINT AS rejected, CASE WHEN sum(k % 3) * 2 > count(*) * 3 + sum(k % 3) THEN 'insufficient_evidence' ELSE 'ok' END AS verdict FROM t GROUP BY dump")
def td_coverage(spark, sf):
    return TD.coverage(thread_table(spark, sf))


@query(_T + " SELECT 'tid:' || k AS identity, name, state, (k % 5 * 10.0)::DOUBLE AS cpu_delta_ms, CASE WHEN k % 7 > 0 THEN 5.0::DOUBLE END AS elapsed_delta_s, CASE WHEN k % 5 > 0 THEN 'active_repeated_stack' WHEN state = 'RUNNABLE' THEN 'repeated_stack' ELSE 'persistent_wait' END AS classification FROM t WHERE k % 3 <> 0 AND k % 6 <> 4")
def td_compare(spark, sf):
    a = thread_table(spark, sf)
    b = a.withColumns({"cpu_ms": F.col("cpu_ms") + F.col("tid") % 5 * 10.0, "elapsed_s": F.when(F.col("tid") % 7 > 0, F.col("elapsed_s") + 5.0), "stack": F.when(F.col("tid") % 3 == 0, F.array(F.lit("com.acme.Other.go"))).otherwise(F.col("stack"))})
    return TD.compare(a, b)
