"""Queries of database rules: suppliers are statements, parts tables and indexes, customers sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.operators import db as R
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


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier is a statement, its revenue the time; nation 3 is one dominant statement."""
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("k"), F.sum(F.floor("l_extendedprice")).alias("ms"))
    s, k = g.select(F.col("l_suppkey").alias("s"), "k", "ms"), F.col("s")
    return s.select(
        F.concat(F.lit("q"), k.cast("string")).alias("query_digest"),
        F.when(k % 5 == 0, "COMMIT").otherwise(F.concat(F.lit("SELECT * FROM t"), (k % 7).cast("string"), F.lit(" WHERE a = ? AND b = ?"))).alias("normalized_sql"),
        (F.col("k") * k * 10).alias("calls"),
        F.when(k == 1, F.col("ms") * 60).otherwise(F.col("ms")).cast("double").alias("total_time_ms"),
        (F.col("k") * 2.0).alias("mean_time_ms"),
        F.when(k % 3 == 0, F.col("k") * 100.0).alias("calls_per_day"),
    )


def tables(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        F.lit("public").alias("schema_name"), F.concat(F.lit("t"), k.cast("string")).alias("name"), (k * 10 * R.MB).alias("size_bytes"), (k * 50).alias("seq_scans"), (k % 60 / 100).alias("dead_tuple_ratio"),
        F.when(k % 2 == 0, "2024-01-01").alias("last_autovacuum"), (k * R.MB * 3).alias("data_free_bytes"), (k % 50).cast("double").alias("growth_30d_pct"),
    )


def indexes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    cols = F.when(k % 4 == 0, F.array(F.lit("a"))).when(k % 4 == 1, F.array(F.lit("a"), F.lit("b"))).when(k % 4 == 2, F.array(F.lit("b"))).otherwise(F.array(F.lit("c")))
    return p.select(
        F.concat(F.lit("public.t"), (F.floor(k / 4)).cast("string")).alias("table"), F.concat(F.lit("i"), k.cast("string")).alias("name"), cols.alias("columns"), F.lit("btree").alias("method"), (k * R.MB).alias("size_bytes"),
        F.when(k % 3 == 0, 0).when(k % 3 == 1, 10).cast("bigint").alias("scans"), (k % 10 == 0).alias("is_primary"), (k % 9 == 0).alias("is_unique"),
    )


_Q = """WITH g AS (SELECT l_suppkey AS s, count(*) AS k, sum(floor(l_extendedprice))::BIGINT AS ms FROM lineitem GROUP BY 1),
q AS (SELECT 'q' || s AS query_digest, s, k, k * s * 10 AS calls, CASE WHEN s = 1 THEN ms * 60 ELSE ms END::DOUBLE AS t, k * 2.0::DOUBLE AS mean, CASE WHEN s % 3 = 0 THEN k * 100.0::DOUBLE END AS cpd FROM g),
q1 AS (SELECT 'R-Q1' AS rule, 'queries' AS category, CASE WHEN t * 100 / (SELECT sum(t) FROM q) > 40 THEN 'CRITICAL' WHEN t * 100 / (SELECT sum(t) FROM q) >= 20 THEN 'HIGH' END AS severity, query_digest AS object, 'high' AS confidence, t * 100 / (SELECT sum(t) FROM q) AS impact FROM q),
q2 AS (SELECT 'R-Q2', 'queries', CASE WHEN mean < 1000 THEN NULL WHEN calls >= 10000 THEN 'HIGH' WHEN calls >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS severity, query_digest, 'high', mean FROM q),
q3 AS (SELECT 'R-Q3', 'queries', CASE WHEN coalesce(cpd, calls) >= 50000 THEN 'MEDIUM' END AS severity, query_digest, CASE WHEN cpd IS NULL THEN 'low' ELSE 'high' END, coalesce(cpd, calls::DOUBLE) FROM q WHERE s % 5 <> 0),
fi AS (SELECT * FROM q1 WHERE severity IS NOT NULL UNION ALL SELECT * FROM q2 WHERE severity IS NOT NULL UNION ALL SELECT * FROM q3 WHERE severity IS NOT NULL)"""


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumn("impact", F.round("impact", 6))


@query(_Q + ", b AS (SELECT query_digest, calls * 2 - CASE WHEN s % 4 = 0 THEN calls * 3 ELSE 0 END AS c2, t * 3 AS t2, calls, t FROM q) SELECT query_digest, (c2 - calls) / 2.0::DOUBLE AS calls_per_day, (t2 - t) / 2.0::DOUBLE AS time_per_day_ms FROM b WHERE c2 >= calls")
def db_delta(spark, sf):
    before = statements(spark, sf)
    s4 = F.regexp_extract("query_digest", r"(\d+)", 1).cast("int") % 4 == 0
    now = before.withColumns({"calls": F.col("calls") * 2 - F.when(s4, F.col("calls") * 3).otherwise(0), "total_time_ms": F.col("total_time_ms") * 3})
    return R.delta(now, before, 2.0)


@query(_Q + " SELECT rule, category, severity, object, confidence, round(impact, 6) AS impact FROM q1 WHERE severity IS NOT NULL")
def db_q1(spark, sf):
    return _rounded(R.q1(statements(spark, sf)))


@query(_Q + " SELECT 'R-Q2' AS rule, 'queries' AS category, severity, query_digest AS object, 'high' AS confidence, mean AS impact FROM (SELECT *, CASE WHEN mean < 1000 THEN NULL WHEN calls >= 10000 THEN 'HIGH' WHEN calls >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM q) WHERE severity IS NOT NULL")
def db_q2(spark, sf):
    return R.q2(statements(spark, sf))


@query(_Q + " SELECT 'R-Q3' AS rule, 'queries' AS category, 'MEDIUM' AS severity, query_digest AS object, CASE WHEN cpd IS NULL THEN 'low' ELSE 'high' END AS confidence, coalesce(cpd, calls::DOUBLE) AS impact FROM q WHERE s % 5 <> 0 AND coalesce(cpd, calls) >= 50000")
def db_q3(spark, sf):
    return R.q3(statements(spark, sf))


_I1 = _Q + ", u AS (SELECT 't' || s % 7 AS t, sum(t) AS ms FROM q WHERE s % 5 <> 0 GROUP BY 1), tb AS (SELECT 't' || p_partkey AS name, p_partkey * 10 AS mb, p_partkey * 50 AS sc FROM part)"


@query(_I1 + " SELECT 'R-I1' AS rule, 'indexes' AS category, CASE WHEN mb >= 1024 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, name AS object, 'medium' AS confidence, ms AS impact FROM (SELECT name, mb * 40 AS mb, ms, sc FROM tb JOIN u ON u.t = tb.name WHERE name IN ('t5', 't6')) WHERE mb >= 100")
def db_i1(spark, sf):
    t = tables(spark, sf).withColumns({"size_bytes": F.col("size_bytes") * 40, "seq_scans": F.col("seq_scans") * 100})
    ix = indexes(spark, sf).where("table <> 'public.t5' and table <> 'public.t6'")
    return R.i1(t, statements(spark, sf), ix)


_IX = """WITH ix AS (SELECT p_partkey AS k, 'public.t' || p_partkey // 4 AS tab, 'i' || p_partkey AS name, ['a', 'a,b', 'b', 'c'][p_partkey % 4 + 1] AS cols, p_partkey * 1048576 AS size, p_partkey % 10 = 0 AS pk, p_partkey % 9 = 0 AS uq FROM part)"""


@query(_IX + " SELECT 'R-I2' AS rule, 'indexes' AS category, CASE WHEN size >= 104857600 THEN 'MEDIUM' ELSE 'LOW' END AS severity, tab || '.' || name AS object, 'medium' AS confidence, size::DOUBLE AS impact FROM ix WHERE k % 3 = 0 AND NOT pk AND NOT uq AND size >= 10485760")
def db_i2(spark, sf):
    return R.i2(indexes(spark, sf))


@query(_IX + " SELECT 'R-I3' AS rule, 'indexes' AS category, 'LOW' AS severity, a.tab || '.' || a.name AS object, 'high' AS confidence, a.size::DOUBLE AS impact FROM ix a WHERE NOT pk AND NOT uq AND EXISTS (SELECT 1 FROM ix b WHERE b.tab = a.tab AND b.name <> a.name AND (b.cols = a.cols OR starts_with(b.cols, a.cols || ',')))")
def db_i3(spark, sf):
    return R.i3(indexes(spark, sf))


@query("SELECT 'R-L1' AS rule, 'ops' AS category, CASE WHEN c_custkey * 10 >= 5000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'b' || c_custkey || '>w' || c_nationkey AS object, 'high' AS confidence, c_custkey * 10.0::DOUBLE AS impact FROM customer WHERE c_custkey * 10 >= 1000")
def db_l1(spark, sf):
    k = F.col("c_custkey")
    w = table(spark, sf, "customer").select(F.concat(F.lit("b"), k.cast("string")).alias("blocker_digest"), F.concat(F.lit("w"), F.col("c_nationkey").cast("string")).alias("blocked_digest"), (k * 10.0).alias("wait_ms"))
    return R.l1(w)


@query("SELECT 'R-C1' AS rule, 'ops' AS category, CASE WHEN n >= 95 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 'connections' AS object, CASE WHEN r_regionkey = 0 THEN 'medium' ELSE 'high' END AS confidence, n::DOUBLE AS impact FROM (SELECT r_regionkey, greatest(85, CASE WHEN r_regionkey > 0 THEN r_regionkey * 25 END) AS n FROM region) WHERE n >= 80")
def db_c1(spark, sf):
    k = F.col("r_regionkey")
    return R.c1(table(spark, sf, "region").select(F.lit(85).alias("current"), F.when(k > 0, k * 25).alias("peak"), F.lit(100).alias("max_limit")))


_TB = "WITH tb AS (SELECT p_partkey AS k, 'public.t' || p_partkey AS name, p_partkey * 10 * 1048576 AS size, p_partkey % 60 / 100 AS dead FROM part)"


@query(_TB + " SELECT 'R-G1' AS rule, 'ops' AS category, 'MEDIUM' AS severity, name AS object, 'medium' AS confidence, round(size * (1 + 3 * (k % 50)::DOUBLE / 100), 3) AS impact FROM tb WHERE size >= 104857600 AND k % 50 >= 20")
def db_g1(spark, sf):
    return R.g1(tables(spark, sf)).withColumn("impact", F.round("impact", 3))


@query(_TB + """ SELECT 'R-M1' AS rule, 'maintenance' AS category, CASE WHEN dead >= 0.4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, name AS object, 'high' AS confidence, round(dead, 6) AS impact FROM tb WHERE dead >= 0.2
UNION ALL SELECT 'R-M2', 'maintenance', 'MEDIUM', name, 'high', round(dead, 6) FROM tb WHERE k % 2 = 1 AND size >= 104857600 AND dead >= 0.05 UNION ALL SELECT 'R-M3', 'maintenance', 'LOW', name, 'low', round(size * dead, 6) FROM tb WHERE size >= 536870912 AND dead >= 0.1 UNION ALL SELECT 'R-M2', 'maintenance', 'HIGH', 'autovacuum', 'high', 1.0""")
def db_m1(spark, sf):
    s = spark.createDataFrame([("autovacuum", "off", None)], "name string, value string, unit string")
    return _rounded(R.maintenance(tables(spark, sf), "postgres", s))


@query(_TB + " SELECT 'R-M4' AS rule, 'maintenance' AS category, 'LOW' AS severity, name AS object, 'high' AS confidence, round(k * 3 * 100.0 / (k * 10), 6) AS impact FROM tb WHERE k * 3 >= 100")
def db_m4(spark, sf):
    return _rounded(R.maintenance(tables(spark, sf), "mysql"))


@query("""WITH s AS (SELECT 'db' || s_suppkey AS server, s_suppkey AS k, (SELECT sum(p_partkey) * 10485760 > 4294967296 FROM part) AS large FROM supplier),
c AS (SELECT server, unnest([{'o': 'shared_buffers', 's': CASE WHEN k % 64 < 32 AND large THEN 'LOW' END}, {'o': 'work_mem', 's': CASE WHEN k % 50 * (k % 700) >= 16384 THEN 'MEDIUM' END}, {'o': 'max_connections', 's': CASE WHEN k % 700 > 500 THEN 'MEDIUM' END},
  {'o': 'effective_cache_size', 's': CASE WHEN k % 3 = 0 THEN 'LOW' END}, {'o': 'random_page_cost', 's': CASE WHEN k % 5 = 4 THEN 'LOW' END}, {'o': 'track_io_timing', 's': CASE WHEN k % 2 = 0 THEN 'INFO' END}, {'o': 'checkpoint_completion_target', 's': CASE WHEN k % 10 < 7 THEN 'LOW' END}]) AS c FROM s)
SELECT 'R-CFG-PG' AS rule, 'config' AS category, c.s AS severity, server || '.' || c.o AS object, 'high' AS confidence, 0.0::DOUBLE AS impact FROM c WHERE c.s IS NOT NULL""")
def db_cfg(spark, sf):
    """A supplier is a server, of which each has settings of its own."""
    k = F.col("s_suppkey")
    of = lambda name, value, unit=None: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(unit).cast("string").alias("unit"))
    rows = [of("shared_buffers", k % 64 * 1024, "8kB"), of("work_mem", k % 50 * 1024, "kB"), of("max_connections", k % 700), of("effective_cache_size", F.when(k % 3 == 0, 524_288).otherwise(1_048_576), "8kB"), of("random_page_cost", k % 5), of("track_io_timing", F.when(k % 2 == 0, "off").otherwise("on")), of("checkpoint_completion_target", k % 10 / 10)]
    d = table(spark, sf, "supplier").select(F.concat(F.lit("db"), k.cast("string")).alias("server"), F.inline(F.array(*rows)))
    size = tables(spark, sf).agg(F.sum("size_bytes")).first()[0] or 0
    return R.config(d, "postgres", size)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'SELECT a FROM t WHERE id = ? AND name = ?' ELSE 'UPDATE t2 SET x = ? WHERE y > ?' END AS sql FROM orders")
def db_redact(spark, sf):
    k = F.col("o_orderkey").cast("string")
    a = F.concat(F.lit("SELECT a  FROM t /* note "), k, F.lit(" */ WHERE id = "), k, F.lit(" AND name = 'it''s "), F.col("o_orderstatus"), F.lit("' -- end"))
    b = F.concat(F.lit("UPDATE t2 SET x = "), F.col("o_totalprice").cast("string"), F.lit(" WHERE y > 0x1F"))
    return table(spark, sf, "orders").select("o_orderkey", R.redact(F.when(F.col("o_orderkey") % 2 == 0, a).otherwise(b)).alias("sql"))


@query("""WITH p AS (SELECT 'app.p' || p_partkey AS object, p_partkey % 6 AS k FROM part), r AS (SELECT object, unnest(CASE k WHEN 0 THEN [{'r': 'SP3', 's': 'MEDIUM'}, {'r': 'SP4', 's': 'LOW'}] WHEN 1 THEN [{'r': 'SP5', 's': 'MEDIUM'}, {'r': 'SP6', 's': 'MEDIUM'}] WHEN 2 THEN [{'r': 'SP2', 's': 'LOW'}] WHEN 3 THEN [{'r': 'SP4', 's': 'LOW'}] END) AS u FROM p WHERE k < 4)
SELECT u.r AS rule, 'procedures' AS category, u.s AS severity, object, 'low' AS confidence, 0.0::DOUBLE AS impact FROM r""")
def db_sp(spark, sf):
    """A part is a routine, in one of six forms: two of them do no harm, or only in comments and literals."""
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    body = F.when(k == 0, F.concat(F.lit("DECLARE c CURSOR FOR SELECT * FROM stock WHERE name = '"), name, F.lit("'; LOOP FETCH c INTO x; END LOOP;")))
    body = body.when(k == 1, F.concat(F.lit("EXECUTE format('x'); SELECT a FROM stock WHERE lower(name) = '"), name, F.lit("'; -- SELECT *")))
    body = body.when(k == 2, F.concat(F.lit("CREATE TEMP TABLE s AS SELECT a FROM stock /* "), name, F.lit(" */;"))).when(k == 3, F.concat(F.lit("CREATE TEMPORARY TABLE s (a int); CREATE INDEX i ON s (a); SELECT  * FROM s WHERE b = '"), name, F.lit("';")))
    body = body.when(k == 4, F.concat(F.lit("SELECT a FROM stock WHERE name = 'select * from "), name, F.lit("';"))).otherwise(F.concat(F.lit("/* cursor for "), name, F.lit(" */ SELECT a FROM stock WHERE b = 1; -- loop")))
    return R.procedures(table(spark, sf, "part").select(F.lit("app").alias("schema_name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), body.alias("definition")))


@query("SELECT 'SP1' AS rule, 'procedures' AS category, 'MEDIUM' AS severity, 'app.r' || p_partkey AS object, 'medium' AS confidence, 0.0::DOUBLE AS impact, CASE p_partkey % 4 WHEN 0 THEN 'o.id' WHEN 1 THEN 'p_id' ELSE 't.id' END AS left, CASE p_partkey % 4 WHEN 0 THEN 'bigint' WHEN 1 THEN 'varchar(20)' ELSE 'varchar(20)' END AS left_type, CASE p_partkey % 4 WHEN 0 THEN 'v_id' ELSE 'o.id' END AS right, CASE p_partkey % 4 WHEN 0 THEN 'varchar(12)' ELSE 'bigint' END AS right_type FROM part WHERE p_partkey % 4 < 3")
def db_sp1(spark, sf):
    k, n = F.col("p_partkey") % 4, F.concat(F.lit("r"), F.col("p_partkey").cast("string"))
    body = F.when(k == 0, "BEGIN DECLARE v_id VARCHAR(12); SELECT o.id FROM app.orders o WHERE o.id = v_id; END").when(k == 1, "SELECT o.id FROM app.orders o WHERE p_id = o.id -- o.id = v")
    body = body.when(k == 2, "CREATE TEMPORARY TABLE tmp (id varchar(20), amount decimal(12,2)); SELECT o.id FROM orders o JOIN tmp t ON t.id = o.id;").otherwise("DECLARE v_id bigint; v_amount numeric(12,2); BEGIN SELECT o.id FROM app.orders o WHERE o.amount = v_amount AND o.id = v_id; END")
    procs = table(spark, sf, "part").select(F.lit("app").alias("schema_name"), n.alias("name"), body.alias("definition"))
    columns = spark.createDataFrame([("app", "orders", "id", "bigint"), ("app", "orders", "amount", "decimal(12,2)")], "schema_name string, table string, name string, data_type string")
    given = procs.select("schema_name", F.col("name").alias("routine"), F.lit("p_id").alias("name"), F.lit("varchar(20)").alias("data_type"))
    return R.type_mismatches(procs, columns, given)


def _all(spark, sf):
    s = statements(spark, sf)
    return R.q1(s).unionByName(R.q2(s)).unionByName(R.q3(s))


@query(_Q + ", c AS (SELECT sum(CASE severity WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 1 ELSE 0 END) AS p FROM fi) SELECT greatest(0, 100 - least(p, 30))::BIGINT AS score FROM c")
def db_score(spark, sf):
    return R.score(_all(spark, sf))


@query(_Q + " SELECT rule, object, severity, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, impact DESC, rule, object) AS place FROM fi")
def db_order(spark, sf):
    return R.ordered(_all(spark, sf)).select("rule", "object", "severity", "place")
