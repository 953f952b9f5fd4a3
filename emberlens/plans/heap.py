"""Queries of heap operators over a reference graph made of regions, nations, customers, suppliers and
orders; priorities refer to orders as well, so that the graph isn't a tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.operators import graph as GR
from emberlens.operators import heap as H
from emberlens.session import table, write_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


CLASSES = [
    ("c:O", "com.acme.shop.Order", "c:B", "app"), ("c:C", "com.acme.shop.Customer", "c:B", "app"), ("c:S", "com.acme.stock.Supplier", "c:B", "web"), ("c:N", "com.acme.Nation", "c:B", "web"), ("c:R", "com.acme.Region", "c:B", "web"), ("c:P", "java.util.HashMap", None, "boot"), ("c:B", "com.acme.shop.Order", None, "old"),
]
_CLASS_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in c) + ")" for c in CLASSES)


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "cid string, name string, super string, loader string")


def _id(letter: str, key: str):
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def objects(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("R", "region", "r_regionkey"), ("N", "nation", "n_nationkey"), ("C", "customer", "c_custkey"), ("S", "supplier", "s_suppkey"), ("O", "orders", "o_orderkey")]
    kind = {"O": "instance", "C": "instance", "S": "instance", "N": "object_array", "R": "instance"}
    made = [table(spark, sf, t).select(_id(x, k).alias("oid"), F.lit(f"c:{x}").alias("class_id"), F.lit(kind[x]).alias("kind"), (24 + F.col(k) % 8 * 8).cast("bigint").alias("shallow"), (F.col(k) % 90 * 2).cast("bigint").alias("length")) for x, t, k in parts]
    p = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("oid")).distinct().select("oid", F.lit("c:P").alias("class_id"), F.lit("instance").alias("kind"), F.lit(48).cast("bigint").alias("shallow"), F.lit(0).cast("bigint").alias("length"))
    return reduce(DataFrame.unionByName, [*made, p])


def edges(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda d, a, b, f, s="strong": d.select(a.alias("src"), b.alias("dst"), F.lit(f).alias("field") if isinstance(f, str) else f.alias("field"), F.lit(s).alias("strength"))
    n, c, s, o = (table(spark, sf, t) for t in ("nation", "customer", "supplier", "orders"))
    slot = F.concat(F.lit("["), F.col("c_custkey").cast("string"), F.lit("]"))
    parts = [
        e(n, _id("R", "n_regionkey"), _id("N", "n_nationkey"), "Region.nations"),
        e(c, _id("N", "c_nationkey"), _id("C", "c_custkey"), slot),
        e(s.where("s_acctbal >= 0"), _id("N", "s_nationkey"), _id("S", "s_suppkey"), "Nation.suppliers"),
        e(o, _id("C", "o_custkey"), _id("O", "o_orderkey"), "Customer.orders"),
        e(o, F.col("o_orderpriority"), _id("O", "o_orderkey"), "Map.value"),
        e(o, _id("O", "o_orderkey"), _id("C", "o_custkey"), "java.lang.ref.Reference.referent", "weak"),
    ]
    return reduce(DataFrame.unionByName, parts)


def roots(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").where("r_regionkey < 3").select(_id("R", "r_regionkey").alias("node"), F.lit("thread").alias("kind"))
    return r.unionByName(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("node"), F.lit("static").alias("kind")).distinct())


def dom(spark: SparkSession, sf: str) -> DataFrame:
    return write_table(GR.dominators(objects(spark, sf).select("oid", "shallow"), H.strong(edges(spark, sf)), roots(spark, sf)), "dominators")


def held(spark: SparkSession, sf: str) -> DataFrame:
    """node, parent, retained without the places that a retained set needs."""
    return GR.dominators(objects(spark, sf).select("oid", "shallow"), H.strong(edges(spark, sf)), roots(spark, sf), places=False)


HEAP_SQL = f"""cl(cid, name, super, loader) AS (VALUES {_CLASS_ROWS}),
ob AS (SELECT 'R' || r_regionkey AS oid, 'c:R' AS class_id, 'instance' AS kind, (24 + r_regionkey % 8 * 8)::BIGINT AS shallow, (r_regionkey % 90 * 2)::BIGINT AS length FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'c:N', 'object_array', 24 + n_nationkey % 8 * 8, n_nationkey % 90 * 2 FROM nation UNION ALL SELECT 'C' || c_custkey, 'c:C', 'instance', 24 + c_custkey % 8 * 8, c_custkey % 90 * 2 FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'c:S', 'instance', 24 + s_suppkey % 8 * 8, s_suppkey % 90 * 2 FROM supplier UNION ALL SELECT 'O' || o_orderkey, 'c:O', 'instance', 24 + o_orderkey % 8 * 8, o_orderkey % 90 * 2 FROM orders
  UNION ALL SELECT DISTINCT o_orderpriority, 'c:P', 'instance', 48, 0 FROM orders),
ed AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'Region.nations' AS field, 'strong' AS strength FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, '[' || c_custkey || ']', 'strong' FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'Nation.suppliers', 'strong' FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'Customer.orders', 'strong' FROM orders
  UNION ALL SELECT o_orderpriority, 'O' || o_orderkey, 'Map.value', 'strong' FROM orders UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, 'java.lang.ref.Reference.referent', 'weak' FROM orders),
ro AS (SELECT 'R' || r_regionkey AS node, 'thread' AS kind FROM region WHERE r_regionkey < 3 UNION ALL SELECT DISTINCT o_orderpriority, 'static' FROM orders),
st AS (SELECT * FROM ed WHERE strength = 'strong'),
re AS (SELECT DISTINCT node FROM ro UNION SELECT dst FROM re JOIN st ON st.src = re.node),
pa AS (SELECT node, '0x0' AS parent, 1 AS depth FROM ro UNION ALL SELECT 'O' || o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM re WHERE node = 'C' || o_custkey) THEN '0x0' ELSE o_orderpriority END, CASE WHEN EXISTS (SELECT 1 FROM re WHERE node = 'C' || o_custkey) THEN 1 ELSE 2 END FROM orders
  UNION ALL SELECT dst, src, CASE dst[1] WHEN 'N' THEN 2 ELSE 3 END FROM st JOIN re ON re.node = st.src WHERE dst[1] IN ('N', 'C', 'S')),
p1 AS (SELECT pa.node, parent, depth, shallow FROM pa JOIN ob ON ob.oid = pa.node),
l3 AS (SELECT node, parent, shallow AS retained FROM p1 WHERE depth = 3),
l2 AS (SELECT p1.node, p1.parent, shallow + coalesce(sum(l3.retained), 0) AS retained FROM p1 LEFT JOIN l3 ON l3.parent = p1.node WHERE p1.depth = 2 GROUP BY p1.node, p1.parent, shallow),
l1 AS (SELECT p1.node, p1.parent, shallow + coalesce(sum(l2.retained), 0) AS retained FROM p1 LEFT JOIN l2 ON l2.parent = p1.node WHERE p1.depth = 1 GROUP BY p1.node, p1.parent, shallow),
dm AS (SELECT node, parent, 3 AS depth, retained::BIGINT AS retained FROM l3 UNION ALL SELECT node, parent, 2, retained::BIGINT FROM l2 UNION ALL SELECT node, parent, 1, retained::BIGINT FROM l1 UNION ALL SELECT '0x0', '0x0', 0, (SELECT sum(retained) FROM l1)::BIGINT)"""
_H = "WITH RECURSIVE " + HEAP_SQL
_HIST = "hi AS (SELECT name AS class_name, count(*) AS instances, sum(shallow)::BIGINT AS bytes FROM ob JOIN cl ON cl.cid = ob.class_id GROUP BY name)"


def _part_hist(spark, sf):
    p = table(spark, sf, "part")
    return H.histogram(p.select(F.col("p_type").alias("class_id"), F.col("p_size").cast("bigint").alias("shallow")), p.select(F.col("p_type").alias("cid"), F.concat(F.lit("com."), F.col("p_type")).alias("name")).distinct())


@query("SELECT 'com.' || p_type AS class_name, count(*) AS instances, sum(p_size)::BIGINT AS bytes FROM part GROUP BY ALL")
def hp_histogram(spark, sf):
    return _part_hist(spark, sf)


@query("SELECT 'com.' || p_type AS name, count(*) AS instances, sum(p_size)::BIGINT AS bytes FROM part WHERE contains(lower('com.' || p_type), 'a') GROUP BY ALL ORDER BY bytes DESC, name DESC LIMIT 3 OFFSET 1")
def hp_hist_query(spark, sf):
    return H.histogram_page(_part_hist(spark, sf), "A", offset=1, limit=3)


@query("""WITH RECURSIVE up(cid, a) AS (SELECT p_partkey, p_partkey FROM part UNION ALL SELECT cid, a // 10 FROM up WHERE a > 0), f AS (SELECT cid, sum(a % 4) AS n FROM up GROUP BY cid HAVING bool_or(a % 4 > 0))
SELECT 'c' || cid AS cid, n::BIGINT AS ref_fields FROM f""")
def hp_ref_fields(spark, sf):
    """A part is a class whose superclass is a tenth of its key, with as many references as its key modulo 4, and one number."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    cls = p.select(_id("c", "p_partkey").alias("cid"), F.lit("C").alias("name"), F.when(k > 0, F.concat(F.lit("c"), F.floor(k / 10).cast("string"))).alias("super"), F.lit("app").alias("loader"))
    refs = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("f"), i.cast("string")).alias("field"), F.when(i == 0, "prim").otherwise("object").alias("kind")))
    return H.ref_fields(cls, p.select(_id("c", "p_partkey").alias("cid"), F.inline(refs)))


@query(_H + " SELECT class_id, kind, count(*) AS n, sum(shallow)::BIGINT AS bytes FROM ob GROUP BY ALL")
def hp_objects(spark, sf):
    return objects(spark, sf).groupBy("class_id", "kind").agg(F.count("*").alias("n"), F.sum("shallow").alias("bytes"))


@query(_H + " SELECT CASE WHEN field LIKE '[%' THEN '[i]' ELSE field END AS field, strength, count(*) AS n FROM ed GROUP BY ALL")
def hp_edges(spark, sf):
    return edges(spark, sf).groupBy(F.when(F.col("field").startswith("["), "[i]").otherwise(F.col("field")).alias("field"), "strength").agg(F.count("*").alias("n"))


@query(_H + " SELECT kind, count(*) AS n FROM ro GROUP BY kind")
def hp_roots(spark, sf):
    return roots(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query(_H + " SELECT field = 'java.lang.ref.Reference.referent' AS referent, count(*) AS n FROM ed WHERE strength = 'weak' GROUP BY ALL")
def hp_weak(spark, sf):
    return edges(spark, sf).join(H.strong(edges(spark, sf)), ["src", "dst", "field", "strength"], "left_anti").groupBy((F.col("field") == "java.lang.ref.Reference.referent").alias("referent")).agg(F.count("*").alias("n"))


@query(_H + " SELECT ob.oid, name, shallow, parent, retained, (SELECT count(*) FROM ed WHERE dst = ob.oid) AS n_in, (SELECT count(*) FROM ed WHERE src = ob.oid) AS n_out, (SELECT string_agg(field || '=' || dst, ',' ORDER BY field, dst) FROM (SELECT src, field, dst FROM ed QUALIFY row_number() OVER (PARTITION BY src ORDER BY field, dst) <= 5) WHERE src = ob.oid) AS fields FROM ob JOIN cl ON cid = class_id LEFT JOIN dm ON node = ob.oid WHERE ob.oid IN ('C1', 'C7', 'O5', 'N3', 'R4', 'S2')")
def hp_object_detail(spark, sf):
    ids = spark.createDataFrame([(x,) for x in ("C1", "C7", "O5", "N3", "R4", "S2")], "oid string")
    d = H.object_detail(objects(spark, sf), classes(spark), edges(spark, sf), held(spark, sf), ids, first=5)
    return d.withColumn("fields", F.array_join(F.transform("values", lambda x: F.concat(x["field"], F.lit("="), x["to"])), ",")).drop("values")


@query(_H + " SELECT oid, name, shallow FROM ob JOIN cl ON cid = class_id WHERE contains(lower(name), 'customer') AND loader = 'app' ORDER BY oid LIMIT 100")
def hp_search(spark, sf):
    return H.search(objects(spark, sf), classes(spark), "CUSTOMER", loader="app")


_TARGETS = ["C1", "C2", "C9", "O3", "O8", "N5", "R4", "S1"]
_PATHS = (
    _H
    + """, tg AS (SELECT unnest(['C1', 'C2', 'C9', 'O3', 'O8', 'N5', 'R4', 'S1']) AS target),
wy AS (SELECT target, target AS tip, [target] AS path, 0 AS hops FROM tg UNION ALL SELECT target, src, list_prepend(src, path), hops + 1 FROM wy JOIN st ON st.dst = wy.tip WHERE tip NOT IN (SELECT node FROM ro) AND hops < 6),
ph AS (SELECT target, tip AS root, hops, path FROM wy WHERE tip IN (SELECT node FROM ro) QUALIFY row_number() OVER (PARTITION BY target ORDER BY hops, path) <= 5)"""
)


def _paths(spark, sf):
    t = spark.createDataFrame([(x,) for x in _TARGETS], "node string")
    return GR.paths_to_roots(H.strong(edges(spark, sf)), roots(spark, sf), t)


@query(_PATHS + " SELECT target, root, hops, array_to_string(path, '>') AS path, false AS partial FROM ph")
def hp_root_paths(spark, sf):
    return _paths(spark, sf).withColumn("path", F.array_join("path", ">"))


@query(_PATHS + ", hp AS (SELECT DISTINCT target, path[i] AS src, path[i + 1] AS dst FROM (SELECT target, path, unnest(range(1, len(path))) AS i FROM ph)) SELECT src, dst, field, string_agg(target, ',' ORDER BY target) AS targets FROM hp JOIN st USING (src, dst) GROUP BY ALL")
def hp_merged_paths(spark, sf):
    return H.merged_paths(_paths(spark, sf), H.strong(edges(spark, sf))).withColumn("targets", F.array_join("targets", ","))


@query(_H + " SELECT node, parent, depth FROM dm")
def hp_dominators(spark, sf):
    return dom(spark, sf).select("node", "parent", "depth")


@query(_H + " SELECT node, retained FROM dm")
def hp_retained(spark, sf):
    return held(spark, sf).select("node", "retained")


@query(_H + ", k AS (SELECT loader AS key, count(*) AS n, sum(shallow)::BIGINT AS shallow, sum(retained)::BIGINT AS retained FROM dm JOIN ob ON oid = node JOIN cl ON cid = class_id WHERE parent = '0x0' GROUP BY loader) SELECT * FROM k")
def hp_dom_children(spark, sf):
    return H.dom_children(dom(spark, sf), objects(spark, sf), classes(spark), "0x0", "loader")


@query(_H + ", hd AS (SELECT node, retained, retained AS size, [node] AS chain FROM dm WHERE parent = '0x0' AND node <> '0x0' ORDER BY retained DESC, node LIMIT 25), bs AS (SELECT parent, node AS child, retained AS cr FROM dm WHERE node <> '0x0' QUALIFY row_number() OVER (PARTITION BY parent ORDER BY retained DESC, node) = 1), cn AS (SELECT node, retained, size, chain, 0 AS h FROM hd UNION ALL SELECT cn.node, cn.retained, cr, list_append(chain, child), h + 1 FROM cn JOIN bs ON bs.parent = chain[-1] WHERE cr >= size * 0.8 AND h < 5) SELECT node, retained, array_to_string(arg_max(chain, len(chain)), '>') AS chain FROM cn GROUP BY node, retained")
def hp_dom_top(spark, sf):
    return H.dom_top(write_table(held(spark, sf), "dominators")).withColumn("chain", F.array_join("chain", ">"))


@query(_H + ", sub AS (SELECT 'R1' AS node UNION ALL SELECT dm.node FROM sub JOIN dm ON dm.parent = sub.node WHERE dm.node <> '0x0') SELECT * FROM sub")
def hp_retained_set_1(spark, sf):
    return H.dom_subtree(dom(spark, sf), "R1")


@query(_H + ", gone AS (SELECT unnest(['N1', 'N2', 'C3']) AS node), wo AS (SELECT DISTINCT node FROM ro WHERE node NOT IN (SELECT node FROM gone) UNION SELECT dst FROM wo JOIN st ON st.src = wo.node WHERE dst NOT IN (SELECT node FROM gone)) SELECT node FROM re WHERE node NOT IN (SELECT node FROM wo)")
def hp_retained_set_n(spark, sf):
    gone = spark.createDataFrame([("N1",), ("N2",), ("C3",)], "node string")
    return GR.retained_without(H.strong(edges(spark, sf)), roots(spark, sf), gone)


@query(_H + " SELECT node AS oid, ro.kind AS root_kind, name, shallow FROM ro LEFT JOIN ob ON oid = node LEFT JOIN cl ON cid = class_id WHERE ro.kind = 'static'")
def hp_roots_browse(spark, sf):
    return H.roots_browse(roots(spark, sf), objects(spark, sf), classes(spark), "static")


@query(_H + " SELECT name AS class_name, count(*) AS instances, sum(shallow)::BIGINT AS bytes FROM ob JOIN cl ON cid = class_id WHERE oid NOT IN (SELECT node FROM re) GROUP BY name")
def hp_unreachable(spark, sf):
    return H.unreachable(objects(spark, sf), classes(spark), dom(spark, sf))


@query(_H + " SELECT c.loader, classes, coalesce(n, 0) AS instances, coalesce(b, 0) AS bytes FROM (SELECT loader, count(DISTINCT name) AS classes FROM cl GROUP BY loader) c LEFT JOIN (SELECT loader, count(*) AS n, sum(shallow)::BIGINT AS b FROM ob JOIN cl ON cid = class_id GROUP BY loader) o USING (loader)")
def hp_loaders(spark, sf):
    return H.loaders(objects(spark, sf), classes(spark))


@query(_H + ", tp AS (SELECT node, name, retained FROM dm JOIN ob ON oid = node JOIN cl ON cid = class_id WHERE parent = '0x0'), cu AS (SELECT greatest(1000.0, retained * 0.02) AS c FROM dm WHERE node = '0x0') SELECT 'object' AS kind, node AS key, name, 1 AS n, retained FROM tp, cu WHERE retained >= c UNION ALL SELECT 'group', name, name, n, r FROM (SELECT name, count(*) AS n, sum(retained)::BIGINT AS r FROM tp GROUP BY name), cu WHERE n > 1 AND r >= c")
def hp_suspects(spark, sf):
    return H.suspects(dom(spark, sf), objects(spark, sf), classes(spark), least=1000, pct=2.0)


def _hashes(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    oid = F.concat(F.lit("0x"), F.hex("doc_id"))
    return d.select(oid.alias("oid"), F.sha2("text", 256).alias("digest"), F.lit(8).alias("etype"), F.col("n_chars").alias("length"), (F.ceil((16 + F.col("n_chars")) / 8) * 8).cast("bigint").alias("shallow"), F.lit(0).alias("coder"))


_DA = "WITH a AS (SELECT '0x' || upper(to_hex(doc_id)) AS oid, sha256(text) AS digest, n_chars AS length, (ceil((16 + n_chars) / 8) * 8)::BIGINT AS shallow FROM documents WHERE text IS NOT NULL)"


@query(_DA + " SELECT 8 AS etype, digest, length, count(*) AS copies, (sum(shallow) - max(shallow))::BIGINT AS wasted FROM a GROUP BY digest, length HAVING count(*) > 1")
def hp_waste_dup_arrays(spark, sf):
    h = _hashes(spark, sf)
    return H.duplicate_arrays(h.select("oid", "digest", "etype"), h.select("oid", "shallow", "length"))


@query(_DA + " SELECT digest, 8 AS etype, length, 0 AS coder, count(*) AS copies, (sum(shallow) - max(shallow))::BIGINT AS wasted, min(oid) AS sample FROM a GROUP BY digest, length HAVING count(*) > 1")
def hp_waste_dup_strings(spark, sf):
    return H.duplicate_strings(_hashes(spark, sf))


@query(_DA + ", g AS (SELECT (sum(shallow) - max(shallow))::BIGINT AS wasted FROM a GROUP BY digest, length HAVING count(*) > 1), t AS (SELECT sum(shallow) AS total FROM a) SELECT sum(wasted)::BIGINT AS wasted, count(*) AS groups, round(sum(wasted) / any_value(total), 9) AS pct, CASE WHEN sum(wasted) / any_value(total) >= 0.15 OR sum(wasted) >= 268435456 THEN 'critical' WHEN sum(wasted) >= 1048576 OR sum(wasted) / any_value(total) >= 0.03 THEN 'warning' END AS severity FROM g, t")
def hp_waste_stream(spark, sf):
    h = _hashes(spark, sf)
    total = h.agg(F.sum("shallow").alias("t")).select("t").scalar()
    return H.waste_report(H.duplicate_strings(h), total).withColumn("pct", F.round("pct", 9))


@query(_DA + " SELECT length(digest) AS width, count(DISTINCT digest) AS digests FROM a GROUP BY ALL")
def hp_array_digest(spark, sf):
    return _hashes(spark, sf).groupBy(F.length("digest").alias("width")).agg(F.countDistinct("digest").alias("digests"))


@query(_H + " SELECT oid, kind, shallow FROM ob WHERE length = 0 AND kind = 'object_array'")
def hp_waste_empty(spark, sf):
    return H.empty_arrays(objects(spark, sf))


@query(_H + ", s AS (SELECT src, count(*) AS k FROM ed WHERE field LIKE '[%' GROUP BY src) SELECT oid, length * 20 AS length, coalesce(k, 0) AS occupied, shallow FROM ob LEFT JOIN s ON src = oid WHERE kind = 'object_array' AND coalesce(k, 0) * 2 < length * 20")
def hp_waste_sparse(spark, sf):
    return H.sparse_arrays(objects(spark, sf).withColumn("length", F.col("length") * 20), edges(spark, sf))


_TLE = [("T1", "M1", "java.lang.Thread.threadLocals"), ("M1", "A1", "java.lang.ThreadLocal$ThreadLocalMap.table"), ("A1", "E1", "[3]"), ("A1", "E2", "[5]"), ("A1", "E3", "[9]"), ("E1", "C1", "java.lang.ref.Reference.referent"), ("E1", "C2", "java.lang.ThreadLocal$ThreadLocalMap$Entry.value"), ("E2", "X9", "java.lang.ref.Reference.referent"), ("E3", "C4", "java.lang.ThreadLocal$ThreadLocalMap$Entry.value")]


@query("SELECT * FROM (VALUES ('T1', 'E1', 'C1', 'C2', 'live'), ('T1', 'E2', 'X9', NULL, 'missing'), ('T1', 'E3', NULL, 'C4', 'cleared')) t(thread, entry, key, value, key_status)")
def hp_waste_threadlocals(spark, sf):
    e = spark.createDataFrame(_TLE, "src string, dst string, field string")
    return H.thread_locals(e, objects(spark, sf))


@query(_H + " SELECT 'com.acme.shop.Order' AS name, count(*) AS instances, count(*) AS referents, sum(shallow)::BIGINT AS bytes FROM ob WHERE class_id = 'c:O'")
def hp_waste_references(spark, sf):
    c = classes(spark).where("cid <> 'c:B'").withColumn("super", F.when(F.col("cid") == "c:O", "c:Ref")).unionByName(spark.createDataFrame([("c:Ref", "java.lang.ref.Reference", None, "boot")], "cid string, name string, super string, loader string"))
    return H.references(objects(spark, sf), c, edges(spark, sf))


@query(_H + ", s AS (SELECT src, count(*) AS k FROM ed WHERE field LIKE '[%' GROUP BY src) SELECT 'L' || n_nationkey AS oid, 'N' || n_nationkey AS table_oid, n_nationkey AS size, n_nationkey * 4 AS capacity, coalesce(k, 0) AS occupied FROM nation LEFT JOIN s ON src = 'N' || n_nationkey")
def hp_waste_collections(spark, sf):
    n = table(spark, sf, "nation")
    c = n.select(_id("L", "n_nationkey").alias("oid"), _id("N", "n_nationkey").alias("table_oid"), F.col("n_nationkey").alias("size"), (F.col("n_nationkey") * 4).alias("capacity"))
    return H.collections(c, edges(spark, sf))


@query("SELECT range::INT AS index, 'C' || c_custkey AS value FROM range(40) LEFT JOIN customer ON c_nationkey = 3 AND c_custkey = range")
def hp_collection_entries(spark, sf):
    return H.list_entries(edges(spark, sf), "N3", 40)


_LOADERS = [("app", "shop.war"), ("old", "shop.war"), ("web", "admin.war"), ("boot", None)]


@query(_H + ", li(loader, artifact) AS (VALUES ('app', 'shop.war'), ('old', 'shop.war'), ('web', 'admin.war'), ('boot', NULL)), ll AS (SELECT c.loader, classes, coalesce(n, 0) AS instances, coalesce(b, 0) AS bytes FROM (SELECT loader, count(DISTINCT name) AS classes FROM cl GROUP BY loader) c LEFT JOIN (SELECT loader, count(*) AS n, sum(shallow)::BIGINT AS b FROM ob JOIN cl ON cid = class_id GROUP BY loader) o USING (loader)) SELECT loader, artifact, classes, instances, bytes, coalesce(artifact = 'shop.war', false) AS stale FROM li LEFT JOIN ll USING (loader)")
def hp_deployments(spark, sf):
    return H.deployments(spark.createDataFrame(_LOADERS, "loader string, artifact string"), objects(spark, sf), classes(spark))


@query("SELECT c_custkey AS thread, CASE WHEN c_custkey % 3 = 0 THEN 'app' WHEN c_custkey % 5 = 0 THEN 'web' WHEN c_custkey % 7 = 0 THEN 'old' END AS owner FROM customer")
def hp_thread_owner(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select(k.alias("thread"), F.when(k % 3 == 0, "app").otherwise("system").alias("class_loader"), F.when(k % 5 == 0, "web").otherwise("boot").alias("target_loader"), F.when(k % 7 == 0, "old").alias("context_loader"))
    return H.thread_owners(t)


@query("SELECT p_name AS name, count(DISTINCT p_brand) AS loaders FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1 ORDER BY loaders DESC, name LIMIT 50")
def hp_dup_classes(spark, sf):
    return H.duplicate_classes(table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("loader")))


@query("""WITH k AS (SELECT p_brand AS loader, CASE WHEN p_partkey % 4 = 0 THEN 'org.shop' ELSE 'com.shop.s' || p_size % 7 END AS package, count(*) AS n FROM part GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY loader ORDER BY n DESC, package) AS rank FROM k QUALIFY rank <= 3""")
def hp_packages(spark, sf):
    """A part is a class, its brand the loader."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("org.shop.C"), k.cast("string"))).otherwise(F.concat(F.lit("com.shop.s"), (F.col("p_size") % 7).cast("string"), F.lit(".deep.C"), k.cast("string")))
    return H.packages(table(spark, sf, "part").select(name.alias("name"), F.col("p_brand").alias("loader")))


@query(_H + ", " + _HIST + ", t AS (SELECT sum(bytes) AS total FROM hi) SELECT class_name, instances, bytes, 'top_class' AS rule, 'warning' AS severity FROM hi, t WHERE bytes / total > 0.3 UNION ALL SELECT class_name, instances, bytes, 'many_instances', 'warning' FROM hi WHERE instances > 100000")
def hp_class_findings(spark, sf):
    return H.class_findings(H.histogram(objects(spark, sf), classes(spark)))


@query(_H + " SELECT 'C' || c_custkey AS oid, 'com.acme.Cache' || c_custkey AS class_name, 'all' AS field, retained FROM customer JOIN dm ON node = 'C' || c_custkey ORDER BY retained DESC, class_name LIMIT 20")
def hp_static_suspects(spark, sf):
    s = table(spark, sf, "customer").select(F.concat(F.lit("com.acme.Cache"), F.col("c_custkey").cast("string")).alias("class_name"), F.lit("all").alias("field"), _id("C", "c_custkey").alias("oid"))
    return H.static_suspects(s, dom(spark, sf))


@query("WITH a AS (SELECT l_partkey AS k, count(*) AS n, sum(l_quantity)::BIGINT AS b FROM lineitem WHERE l_shipdate < '1995-06-01' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n, sum(l_quantity)::BIGINT AS b FROM lineitem WHERE l_shipdate >= '1995-06-01' GROUP BY 1) SELECT coalesce(a.k, b.k)::VARCHAR AS class_name, coalesce(b.n, 0) - coalesce(a.n, 0) AS d_instances, coalesce(b.b, 0) - coalesce(a.b, 0) AS d_bytes, a.k IS NULL AS is_new FROM a FULL JOIN b ON a.k = b.k")
def x_heap_compare(spark, sf):
    h = lambda c: table(spark, sf, "lineitem").where(c).groupBy(F.col("l_partkey").cast("string").alias("class_name")).agg(F.count("*").alias("instances"), F.sum("l_quantity").cast("bigint").alias("bytes"))
    return H.compare(h("l_shipdate < '1995-06-01'"), h("l_shipdate >= '1995-06-01'"), top=None)


@query(_H + ", " + _HIST + ", fr AS (SELECT 'com.acme.shop.Order' AS cls, count(*) AS threads FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'com.acme.Nation', count(*) FROM customer WHERE c_custkey % 2 = 1) SELECT cls, bytes, threads, cls = 'com.acme.Nation' AS is_static FROM fr JOIN hi ON class_name = cls")
def x_correlate(spark, sf):
    f = table(spark, sf, "customer").select(F.col("c_name").alias("thread"), F.when(F.col("c_custkey") % 2 == 0, "com.acme.shop.Order$1").otherwise("com.acme.Nation").alias("class_name"))
    s = spark.createDataFrame([("com.acme.Nation",)], "class_name string")
    return H.correlate(H.histogram(objects(spark, sf), classes(spark)), f, s)
