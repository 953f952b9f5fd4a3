"""Rules over routine bodies and source files, on small cases."""

import pytest
from pyspark.sql import functions as F

from emberlens.operators import db as R
from emberlens.operators import graph as G
from emberlens.operators import heap as H
from emberlens.operators.quantiles import nearest_rank, numbered
from emberlens.sources import snapshots

READINGS = [("plant", "reading", c, t) for c, t in (("station", "int"), ("code", "varchar(16)"), ("level", "double precision"), ("taken", "timestamp"), ("cost", "numeric(9,3)"), ("extra", "jsonb"))]
READINGS += [("plant", "station", "no", "varchar(4)"), ("plant", "station", "opened", "date")]
COLUMNS = "schema_name string, table string, name string, data_type string"
CASES = {
    "a predicate of an update, the table's own name": ("DECLARE wanted text; BEGIN UPDATE plant.reading SET level = 0 WHERE reading.station = wanted; END", {("reading.station", "wanted")}),
    "a predicate of a delete, sides turned": ("DECLARE most decimal(10,3); BEGIN DELETE FROM plant.reading AS r WHERE most = r.cost; END", {("most", "r.cost")}),
    "decimals of one precision and scale": ("DECLARE most decimal(9, 3); BEGIN DELETE FROM plant.reading r WHERE most = r.cost; END", set()),
    "columns of two tables": ("SELECT r.code FROM plant.station s LEFT JOIN plant.reading r ON s.no = r.station", {("s.no", "r.station")}),
    "kinds of time are one kind": ("DECLARE since date; BEGIN SELECT r.code FROM plant.reading r WHERE r.taken = since; END", set()),
    "floats and whole numbers": ("BEGIN SELECT r.code FROM plant.reading r WHERE r.level = p_level; END", {("r.level", "p_level")}),
    "only equality tells": ("DECLARE wanted text; BEGIN SELECT r.code FROM plant.reading r WHERE r.station >= wanted; END", set()),
    "two variables, no column": ("DECLARE x text; y int; BEGIN SELECT r.code FROM plant.reading r WHERE x = y; END", set()),
    "a call isn't a variable": ("DECLARE lower text; BEGIN SELECT r.code FROM plant.reading r WHERE r.station = lower(p_level); END", set()),
    "types of no known kind": ("DECLARE doc text; BEGIN SELECT r.code FROM plant.reading r WHERE r.extra = doc; END", set()),
    "declared twice with different types": ("DECLARE v text; BEGIN DECLARE v int; SELECT r.code FROM plant.reading r WHERE r.station = v; END", set()),
    "a column of the table by the same name": ("DECLARE cost text; BEGIN SELECT r.code FROM plant.reading r WHERE r.level = cost; END", set()),
    "a table made for the time being": ("CREATE LOCAL TEMP TABLE pick (station varchar(8), level double precision); DELETE FROM plant.reading r USING x JOIN pick k ON k.level = r.level AND r.station = k.station", {("r.station", "k.station")}),
    "declared in a comment or a string alone": ("/* DECLARE wanted text; */ SELECT 'DECLARE wanted text; ' FROM plant.reading r WHERE r.station = wanted", set()),
    "a select within the predicate": ("DECLARE wanted text; BEGIN DELETE FROM plant.reading r WHERE r.station = wanted AND r.code IN (SELECT s.no FROM plant.station s); END", set()),
}


@pytest.mark.parametrize("case", CASES)
def test_types_of_compared_columns(spark, case):
    body, want = CASES[case]
    procs = spark.createDataFrame([("plant", "tidy", body)], "schema_name string, name string, definition string")
    given = spark.createDataFrame([("plant", "tidy", "p_level", "smallint")], "schema_name string, routine string, name string, data_type string")
    got = R.type_mismatches(procs, spark.createDataFrame(READINGS, COLUMNS), given)
    assert {(r.left, r.right) for r in got.collect()} == want


def test_a_bare_name_that_two_schemas_have_tells_nothing(spark):
    procs = spark.createDataFrame([("plant", "tidy", "DECLARE wanted text; BEGIN DELETE FROM reading WHERE reading.station = wanted; END")], "schema_name string, name string, definition string")
    assert R.type_mismatches(procs, spark.createDataFrame(READINGS, COLUMNS)).count() == 1
    assert R.type_mismatches(procs, spark.createDataFrame([*READINGS, ("old", "reading", "station", "int")], COLUMNS)).count() == 0


def test_operations_on_own_fields(spark):
    source = """class A {
  private final Map<String, List<String>> cache = new HashMap<>();
  static Set<String> seen;
  private Listener one;
  void run(String key, Set<String> seen) {
    cache.put(key, List.of()); other.cache.put(1, 2);
    seen.add(key);
    this.seen.clear();
    one = null; // one = make();
    if (one == null) { one = make("cache.put(x)"); }
    cache.values().size();
  }
}"""
    d = spark.createDataFrame([("/A.java", source)], "path string, source string")
    got = {(r.field, r.operation, r.category) for r in snapshots.field_operations(d).collect()}
    assert got == {("cache", "put", "candidate_write"), ("cache", "values", "other_usage"), ("seen", "clear", "candidate_cleanup"), ("one", "null assignment", "candidate_cleanup"), ("one", "assignment", "candidate_write")}


def test_quantiles_are_those_of_sorting(spark):
    rows = [(k, (i * 7919) % 50_000 if k == "a" else i % 3) for k, n in (("a", 3001), ("b", 40), (None, 5)) for i in range(n)] + [("a", None)]
    d = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: (r.n, r.p50, r.p95) for r in nearest_rank(d, ("k",), "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for k in ("a", "b", None):
        v = sorted(x for g, x in rows if g == k and x is not None)
        at = lambda q: v[max(1, -(-int(q * 100) * len(v) // 100)) - 1]  # noqa: E731, B023
        assert got[k] == (len(v), at(0.5), at(0.95))
    assert nearest_rank(d.limit(0), ("k",), "v", {"p": 0.5}).count() == 0


def test_places_over_ranges(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert {(r.x, r.place) for r in numbered(d, ["x"], "place").collect()} == {(i, i + 1) for i in range(1000)}
    assert numbered(d.limit(0), ["x"], "place").count() == 0


def test_searches_go_to_the_end(spark):
    n = 20
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(n)], "src string, dst string")
    assert G.reachable(e, spark.createDataFrame([("n000",)], "node string")).count() == n + 1
    c = spark.createDataFrame([(f"c{i}", f"c{i + 1}" if i < 20 else None) for i in range(21)] + [("x", "y"), ("y", "x")], "cid string, super string")
    got = {(r.cid, r.ancestor): r.hops for r in H.class_chain(c).collect()}
    assert got[("c0", "c20")] == 20 and ("x", "y") in got and len(got) == 21 * 22 // 2 + 4


def test_cycles_behind_long_ways(spark):
    step = [(f"a{i:02}", f"a{i + 1:02}") for i in range(30)] + [("a30", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("s", "s"), ("x", "y"), ("y", "z")]
    got = {r.node: r.cycle for r in G.cycles(spark.createDataFrame(step, "node string, next string")).collect()}
    assert got == {"c1": "c1", "c2": "c1", "c3": "c1", "s": "s"}
    assert G.cycles(spark.createDataFrame(step[-2:], "node string, next string")).count() == 0
