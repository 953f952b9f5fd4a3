"""Contraction, dominators and labels of graphs and trees against plain code."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlens.operators import contract as C
from emberlens.operators import graph as G
from emberlens.operators import heap as H


def random_graphs(seed, n_graphs):
    """Edges and roots of graphs with chains, trees, circles and shared sinks, side by side."""
    rng = random.Random(seed)
    edges, roots = [], []
    for g in range(n_graphs):
        n = rng.choice([1, 4, 9, 25, 60])
        name = [f"g{g:02d}n{i:02d}" for i in range(n)]
        mine = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.5, 0.9, 1.3, 2])))]
        if rng.random() < 0.6:
            mine += [(i, i + 1) for i in range(n - 1) if rng.random() < 0.9]
        if rng.random() < 0.3:
            mine += [(i, n - 1) for i in range(n - 1)]
        edges += [(name[a], name[b]) for a, b in mine]
        roots += rng.sample(name, min(n, rng.randint(1, 3)))
    return edges, roots


def frames(spark, edges, roots, extra=()):
    nodes = sorted({x for e in edges for x in e} | set(roots) | set(extra))
    o = spark.createDataFrame([(x, i % 7 + 1) for i, x in enumerate(nodes)], "oid string, shallow long")
    return o, spark.createDataFrame(edges + [("unknown", nodes[0])], "src string, dst string"), spark.createDataFrame([(x,) for x in roots], "node string")


def plain_reach(edges, roots, without=()):
    out, todo = set(), [r for r in roots if r not in without]
    to = {}
    for a, b in edges:
        to.setdefault(a, []).append(b)
    while todo:
        v = todo.pop()
        if v not in out:
            out.add(v)
            todo += [u for u in to.get(v, ()) if u not in without]
    return out


def check_tree(rows, weight):
    """Depths, retained sizes and places of a dominator tree by plain code."""
    up = {r.node: r.parent for r in rows}
    below = {x: [] for x in up}
    for x in up:
        y = x
        while True:
            below[y].append(x)
            if y == C.ROOT:
                break
            y = up[y]
    by = {r.node: r for r in rows}
    for x, under in below.items():
        assert by[x].retained == sum(weight.get(y, 0) for y in under), x
        assert sorted(by[y].pre for y in under) == list(range(by[x].pre, by[x].last + 1)), x
    for x in up:
        assert by[x].depth == (0 if x == C.ROOT else by[up[x]].depth + 1)


def test_contracted_dominators_are_those_of_the_kernel(spark):
    edges, roots = random_graphs(11, 34)
    o, e, r = frames(spark, edges, roots)
    weight = {x.oid: x.shallow for x in o.collect()}
    whole = G.dominators(o, e, r).collect()
    small = G.dominators(o, e, r, limit=0).collect()
    assert {x.node: x.parent for x in small} == {x.node: x.parent for x in whole}
    for rows in (whole, small):
        check_tree(rows, weight)
    # a dominator is what can't be gone around
    reach = plain_reach(edges, roots)
    assert {x.node for x in whole} == reach | {C.ROOT}
    up = {x.node: x.parent for x in whole}
    for v in sorted(reach)[::11]:
        x, mine = up[v], set()
        while x != C.ROOT:
            mine.add(x)
            x = up[x]
        assert mine == {u for u in reach - {v} if v not in plain_reach(edges, roots, {u})}


def test_chains_that_grow_in_later_rounds_keep_their_order(spark):
    """Of two nodes of a chain that was found in two rounds, the lower one was taken for what dominates both."""
    tree = lambda p, k: [(p, p + x) for x in "01"] + [e for x in "01" for e in tree(p + x, k - 1)] if k else []
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("c", "x"), ("x", "y"), ("d", "e"), ("e", "f0"), ("e", "f1"), *tree("f0", 4), *tree("f1", 4)]
    edges += [("c", "z"), ("d", "z"), ("b", "w"), ("d", "w"), ("a", "v"), ("e", "v"), ("f0000", "u"), ("f1111", "u")]
    o, e, r = frames(spark, edges, ["a"])
    for limit in (0, C.CORE):
        up = {x.node: x.parent for x in G.dominators(o, e, r, limit=limit).collect()}
        assert [up[k] for k in "zwvud"] == ["c", "b", "a", "e", "c"]


def test_children_of_one_node_are_dealt_to_parts(spark, monkeypatch):
    """All children of a node were sorted before; places stay gapless where they are dealt to several windows."""
    monkeypatch.setattr(C, "SIBLINGS", 100)
    tree = spark.range(2_000).selectExpr("id AS node", "if(id < 1500, 0, id - 1500) AS parent", "1 AS weight")
    lab = {r.node: r for r in C.labels(tree, limit=10).collect()}
    assert sorted(r.pre for r in lab.values()) == list(range(2_000))
    for i in range(1, 2_000):
        up, me = lab[max(i - 1_500, 0)], lab[i]
        assert up.pre < me.pre <= me.last <= up.last


def test_a_core_is_refused_only_beyond_the_kernel(spark, monkeypatch):
    n = 1_000
    edges = [(f"a{i:04d}", f"a{i + 1:04d}") for i in range(n)] + [(f"a{i:04d}", f"b{i:04d}") for i in range(n)] + [(f"a{i:04d}", "shared") for i in range(n)]
    o, e, r = frames(spark, edges, ["a0000"])
    monkeypatch.setattr(G, "MAX_OBJECTS", 50)
    rows = G.dominators(o, e, r, limit=50).collect()
    got = {x.node: (x.parent, x.depth) for x in rows}
    assert got["shared"] == ("a0000", 2) and got["b0999"] == ("a0999", 1_001) and len(got) == 2 * n + 3
    circle = [(f"c{i:02d}", f"c{(i + s) % 40:02d}") for i in range(40) for s in (1, 3)]
    o, e, r = frames(spark, circle, ["c00"])
    with pytest.raises(ValueError, match="edges"):
        G.dominators(o, e, r, limit=20)


def test_no_edges_and_no_roots(spark):
    o, e, r = frames(spark, [("a", "b")], ["a"])
    for limit in (0, 100):
        got = {x.node: x.parent for x in G.dominators(o, e.limit(0), r, limit=limit).collect()}
        assert got == {C.ROOT: C.ROOT, "a": C.ROOT}
        assert {x.node for x in G.dominators(o, e, r.limit(0), limit=limit).collect()} == {C.ROOT}


def named(expr):
    return F.format_string("n%07d", F.expr(expr))


def test_retained_sets_of_deep_trees_are_ranges(spark):
    n = 100_000
    d = spark.range(n).select(named("id").alias("node"), named("id - 1").alias("parent"), "id")
    tree = d.selectExpr("node", "if(id = 0, node, parent) AS parent", "1 AS weight")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    lab = C.labels(tree, limit=1_000)
    dom = lab.join(tree.select("node", "parent"), "node")
    assert H.dom_subtree(dom, "n0090000").count() == n - 90_000
    assert lab.where("depth <> pre or weight <> last - pre + 1").isEmpty()
    bushy = spark.range(1, 5_000).selectExpr("format_string('b%05d', id) AS node", "format_string('b%05d', greatest(id div 7, 1)) AS parent", "id AS weight")
    lab = {r.node: r for r in C.labels(bushy, limit=20).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.pre for r in lab.values()) == list(range(4_999))
    for i in range(2, 5_000):
        up, me = lab[f"b{max(i // 7, 1):05d}"], lab[f"b{i:05d}"]
        assert up.pre < me.pre <= me.last <= up.last and me.depth == up.depth + 1
    assert lab["b00001"].weight == sum(range(1, 5_000))


def test_reachability_however_far(spark):
    n = 100_000
    line = spark.range(n).select(named("id").alias("src"), named("id + 1").alias("dst"))
    leaves = spark.range(n).selectExpr("format_string('n%07d', id) AS src", "format_string('p%07d', id) AS dst")
    e = line.unionByName(leaves)
    start = spark.createDataFrame([("n0000007",)], "node string")
    assert G.reachable(e, start, limit=1_000).count() == 2 * n + 1 - 14
    stop = spark.createDataFrame([("n0050000",)], "node string")
    assert G.reachable(e, start, without=stop).count() == 2 * (50_000 - 7)


def test_reachability_of_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(G, "FRONTS", 1)
    edges, roots = random_graphs(5, 30)
    _, e, r = frames(spark, edges, roots)
    for limit in (0, C.CORE):
        assert {x.node for x in G.reachable(e, r, limit=limit).collect()} == plain_reach(edges, roots)
    gone = sorted({x for p in edges for x in p})[::9]
    w = spark.createDataFrame([(x,) for x in gone], "node string")
    assert {x.node for x in G.reachable(e, r, without=w, limit=3).collect()} == plain_reach(edges, roots, set(gone))


def test_heavy_paths():
    rng = np.random.default_rng(1)
    parent = np.array([0, *[int(rng.integers(0, i)) for i in range(1, 200)], -1])
    names = pa.array([f"n{i:03d}" for i in range(201)])
    rows = {r["node"]: r for r in C.paths_of(names, parent).to_pylist()}
    assert len(rows) == 200
    for r in rows.values():
        top = rows[r["top"]]
        assert r["up"] == top["parent"] and (r["top"] == r["node"]) == (r["pos"] == [0])
        if r["top"] != r["node"]:
            assert rows[r["parent"]]["top"] == r["top"] and rows[r["parent"]]["pos"] == [r["pos"][0] - 1]
    assert max(r["level"] for r in rows.values()) <= 8


def test_retained_sizes_without_places_are_the_same(spark):
    edges, roots = random_graphs(3, 5)
    o, e, r = frames(spark, edges, roots, extra=["alone"])
    kept = lambda d: {(x.node, x.parent, x.retained) for x in d.select("node", "parent", "retained").collect()}
    whole = kept(G.dominators(o, e, r))
    assert kept(G.dominators(o, e, r, limit=20, places=False)) == whole == kept(G.dominators(o, e, r, places=False))


def test_weights_of_chains_and_bushes(spark):
    rng = random.Random(5)
    parent = [0] + [i - 1 if 40 < i < 140 else rng.randrange(i) for i in range(1, 400)]
    total = [i % 5 + 1 for i in range(400)]
    for v in range(399, 0, -1):
        total[parent[v]] += total[v]
    tree = spark.createDataFrame([(i, p, i % 5 + 1) for i, p in enumerate(parent)], "node long, parent long, weight long")
    assert {r.node: r.weight for r in C.weights(tree, limit=100).collect()} == dict(enumerate(total))


def test_chains_of_top_dominators(spark):
    """The largest child goes on where it holds most, the first by name of two that do as much."""
    rows = [("0x0", "0x0", 300), ("a", "0x0", 100), ("b", "a", 90), ("c", "b", 80), ("d", "c", 10), ("e", "0x0", 100), ("f", "e", 79), ("g", "0x0", 50), ("i", "g", 25), ("h", "g", 25)]
    dom = spark.createDataFrame(rows, "node string, parent string, retained long")
    top = {r.node: r.chain for r in H.dom_top(dom).collect()}
    assert top == {"a": ["a", "b", "c"], "e": ["e"], "g": ["g"]}
    assert {r.node: r.chain for r in H.dom_top(dom, share=0.5, hops=1).collect()} == {"a": ["a", "b"], "e": ["e", "f"], "g": ["g", "h"]}


def test_details_of_few_objects_move_no_other_rows(spark):
    o = spark.createDataFrame([(f"o{i}", "c", 8) for i in range(50)], "oid string, class_id string, shallow long")
    c = spark.createDataFrame([("c", "C")], "cid string, name string")
    e = spark.createDataFrame([("o0", f"o{i}", f"f{i}") for i in range(1, 50)], "src string, dst string, field string")
    dom = spark.createDataFrame([(f"o{i}", "o0", 8) for i in range(50)], "node string, parent string, retained long")
    d = H.object_detail(o, c, e, dom, spark.createDataFrame([("o0",), ("o7",)], "oid string"), first=2)
    assert {(r.oid, r.n_in, r.n_out, r.parent, len(r["values"] or [])) for r in d.collect()} == {("o0", 0, 49, "o0", 2), ("o7", 1, 0, "o0", 0)}
    # objects, dominators and both ends of the edges
    assert d._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi, (oid") + d._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi, (src") >= 3
    assert d._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") >= 5
