"""Queries of ingestion, comparison and validation helpers over log lines written as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.functions import text as T
from emberlens.operators import compare as C
from emberlens.plans.text import LINES_SQL, event_lines
from emberlens.session import cut_lineage, shared_dir, table
from emberlens.sources import lines as S
from emberlens.sources import snapshots as X

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def log_dir(spark: SparkSession, sf: str) -> DataFrame:
    """Event lines written as four text files and read again."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    event_lines(spark, sf).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("line").write.text(path)
    return S.read_lines(spark, path)


_L = "WITH " + LINES_SQL


@query("SELECT count(*) AS lines FROM events")
def src_log_dir(spark, sf):
    return log_dir(spark, sf).agg(F.count("*").alias("lines"))


@query(_L + " SELECT count(*) AS lines, count(*) FILTER (event_id % 8 NOT IN (3, 4)) AS records, count(*) FILTER (event_id % 8 IN (3, 4)) AS continuations, 0 AS without_ts, count(*) FILTER (event_id % 8 NOT IN (0, 1, 3, 4)) AS without_call_site FROM l")
def src_parse_stats(spark, sf):
    return S.parse_stats(log_dir(spark, sf))


@query(_L + " SELECT count(*) FILTER (event_id % 8 = 0) AS matched, count(*) FILTER (event_id % 8 IN (1, 2, 5, 6, 7)) AS malformed, count(*) FILTER (event_id % 8 = 0) / count(*) FILTER (event_id % 8 NOT IN (3, 4)) AS rate FROM l")
def src_match_rate(spark, sf):
    return S.match_rate(log_dir(spark, sf), first=10**9)


@query(_L + " SELECT CASE WHEN event_id % 8 = 2 THEN 2 ELSE 0 END AS n_continuations, count(*) AS records FROM l WHERE event_id % 8 NOT IN (3, 4) GROUP BY ALL")
def src_record_assembly(spark, sf):
    return S.read_records(log_dir(spark, sf)).groupBy("n_continuations").agg(F.count("*").alias("records"))


@query("SELECT 4 AS files")
def src_file_order(spark, sf):
    return S.file_order(log_dir(spark, sf)).agg(F.count("*").alias("files"))


@query("SELECT 5 AS fields, 'yyyy-MM-dd HH:mm:ss.SSS' AS timestamp")
def src_detect_format(spark, sf):
    piped = log_dir(spark, sf).where(F.col("line").contains("|"))
    r = S.detect_format(piped) or {}
    return spark.createDataFrame([(r.get("fields"), r.get("timestamp"))], "fields int, timestamp string")


@query(_L + " SELECT event_id, regexp_matches(line, '(^|[^0-9A-Za-z_-])17($|[^0-9A-Za-z_-])') AS hit FROM l")
def cmp_exact_token(spark, sf):
    return event_lines(spark, sf).select("event_id", C.token(F.col("line"), "17").alias("hit"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Flows of neighbouring users as good and bad ones."""
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pair = F.floor(F.col("user_id") / 2).cast("string")
    return e.select(pair.alias("pair"), F.when(F.col("user_id") % 2 == 0, "good").otherwise("bad").alias("bucket"), (F.row_number().over(order) - 1).alias("seq"), F.col("event_type").alias("key"))


@query()
def cmp_align(spark, sf):
    return C.align(_pairs(spark, sf))


@query("SELECT (user_id // 2)::VARCHAR AS pair, count(*) FILTER (user_id % 2 = 0) AS good, count(*) FILTER (user_id % 2 = 1) AS bad FROM events GROUP BY ALL")
def cmp_order(spark, sf):
    a = C.align(_pairs(spark, sf))
    return a.groupBy("pair").agg(F.count("good_seq").alias("good"), F.count("bad_seq").alias("bad"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'b:MISSING_IN_BAD' WHEN o_orderkey % 3 = 1 THEN 'c:VALUE_DIFFERS' ELSE 'd:EXTRA_IN_BAD' END AS diffs FROM orders")
def cmp_fields(spark, sf):
    k = F.col("o_orderkey") % 3
    m = lambda **x: F.create_map(*[v for n, c in x.items() for v in (F.lit(n), F.lit(c))])
    bad = F.when(k == 0, m(a="1", c="3")).when(k == 1, m(a="1", b="2", c="4")).otherwise(m(a="1", b="2", c="3", d="5"))
    d = C.field_diffs(m(a="1", b="2", c="3"), bad, [])
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(d, lambda x: F.concat(x["key"], F.lit(":"), x["kind"])), ",").alias("diffs"))


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    """All lines with a flow id each, but for stack frames; two neighbouring users share a file, and the
    even one's flow is the good one."""
    e = event_lines(spark, sf)
    ref = F.when(F.col("user_id") % 2 == 0, "good-77 requestId=abcdef1").otherwise("bad-88 requestId=fedcba2")
    return cut_lineage(e.select(F.floor(F.col("user_id") / 2).cast("string").alias("file"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 8 == 3, F.col("line")).otherwise(F.concat("line", F.lit(" ref="), ref)).alias("line")))


_FLOW = """WITH f AS (SELECT user_id // 2 AS file, user_id, event_id, event_id % 8 <> 3 AS hit FROM events),
o AS (SELECT *, max(CASE WHEN hit THEN event_id END) OVER (PARTITION BY file ORDER BY event_id) AS owner FROM f)"""


@query(_FLOW + " SELECT file::VARCHAR AS file, CASE WHEN max(CASE WHEN hit THEN user_id END) % 2 = 0 THEN 'good' ELSE 'bad' END AS bucket, owner AS line_no, count(*) FILTER (NOT hit)::INT AS n FROM o WHERE owner > 0 GROUP BY file, owner")
def cmp_scan(spark, sf):
    return C.scan(_flow(spark, sf), {"good": ["good-77"], "bad": ["bad-88"]}).select("file", "bucket", "line_no", F.size("continuations").alias("n"))


@query("SELECT * FROM (VALUES ('good', 'requestId', 'abcdef1'), ('bad', 'requestId', 'fedcba2')) t(bucket, key, value)")
def cmp_links(spark, sf):
    found = C.links(C.scan(_flow(spark, sf), {"good": ["good-77"], "bad": ["bad-88"]}), ["good-77", "bad-88"])
    return found.where("key = 'requestId'")


@query()
def cmp_break(spark, sf):
    steps = C.flow_steps(_flow(spark, sf), "good-77", "bad-88", pair=F.col("file"))
    steps = cut_lineage(steps.select("pair", "bucket", "seq", "key", "payload", "is_error"))
    return C.break_index(C.compare_flows(steps, "good-77", "bad-88"))


@query()
def cmp_errors(spark, sf):
    return C.errors_only_in_bad(C.flow_steps(_flow(spark, sf), "good-77", "bad-88", pair=F.col("file")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '''=' || p_name WHEN p_partkey % 3 = 1 THEN '''-' || p_name ELSE p_name END AS cell FROM part")
def sink_histogram_csv(spark, sf):
    k = F.col("p_partkey") % 3
    raw = F.concat(F.when(k == 0, "=").when(k == 1, "-").otherwise(""), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.guarded(raw).alias("cell"))


@query("WITH n AS (SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ns(ts) // 1000000, event_id) AS i FROM events), a AS (SELECT user_id, min(i) FILTER (event_type = 'error') AS hit, max(i) AS last FROM n GROUP BY user_id) SELECT n.user_id::VARCHAR AS flow_key, event_id AS o2, i - coalesce(hit, last) AS distance FROM n JOIN a USING (user_id) WHERE abs(i - coalesce(hit, last)) <= 5")
def ctx_log_context(spark, sf):
    from emberlens.operators.segment import group_key
    from emberlens.plans.adapters import event_records

    return context(group_key(event_records(spark, sf)), "error").select("flow_key", "o2", "distance")


def context(records: DataFrame, site: str, around: int = 5) -> DataFrame:
    """Records near the first of each flow at a call site, or near its last where there is none."""
    from pyspark.sql import Window

    d = records.withColumn("i", F.row_number().over(Window.partitionBy("flow_key").orderBy("o1", "o2")))
    whole = Window.partitionBy("flow_key")
    at = F.coalesce(F.min(F.when(F.col("call_site") == site, F.col("i"))).over(whole), F.max("i").over(whole))
    return d.withColumn("distance", F.col("i") - at).where(F.abs("distance") <= around)


@query("SELECT sha256(string_agg(name || ':' || size, chr(10) ORDER BY name)) AS fingerprint FROM (SELECT 'f' || event_id % 4 AS name, count(*) AS size FROM events GROUP BY 1)")
def fp_corpus(spark, sf):
    files = table(spark, sf, "events").groupBy(F.concat(F.lit("f"), (F.col("event_id") % 4).cast("string")).alias("name")).agg(F.count("*").alias("size"))
    return files.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "size"))), lambda x: F.concat(x["name"], F.lit(":"), x["size"].cast("string"))), "\n"), 256).alias("fingerprint"))


@query(_L + r""" SELECT event_id, nullif(regexp_extract(replace(line, '"', ''), '(?i)\b(?:trace[_-]?id|traceId)\s*[=:]\s*["'']?([\w.-]{1,128})', 1), '') AS trace_id, nullif(regexp_extract(line, '((?:[\w$]+\.)*[\w$]*(?:Exception|Error|Throwable))\b', 1), '') AS exception FROM l""")
def fn_ids(spark, sf):
    from emberlens.sources import server_log as G

    d = event_lines(spark, sf)
    return d.select("event_id", T.found(F.regexp_replace("line", '"', ""), G.TRACE_ID, 1).alias("trace_id"), T.found(F.col("line"), G.EXCEPTION, 1).alias("exception"))
