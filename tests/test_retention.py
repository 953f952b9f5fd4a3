"""Connected retention paths against a walk in plain code."""

import random

from emberlens.operators.evidence import trace_retention

CLASS = "oid string, class_name string"
EDGE = "src string, dst string, field string, strength string, row long"


def walked(edges, roots, trace, names, levels):
    """(kind, holder, objects) of one trace: a breadth-first walk, the first terminal in the order of the rows."""
    rows = sorted(e for e in edges if e[3] == "strong")
    rows.sort(key=lambda e: e[4])
    static = {}
    for src, dst, field, _, _ in rows:
        if field.startswith("static:"):
            static.setdefault(dst, (src, field))
    path, front = {x: [x] for x in trace}, sorted(trace)
    for k in range(levels + 1):
        for x in front:
            own = k > 0 and names[x].startswith("com.acme") and not first[x].startswith("[")
            if x in static:
                return "static", static[x][0], path[x]
            if own:
                return "field", x, path[x]
            if x in roots:
                return "root", x, path[x]
        if k == levels:
            break
        first, new = {}, []
        for src, dst, field, _, _ in rows:
            if dst in front and src not in path and src not in first and not field.startswith(("static:", "<")):
                first[src] = field
                new.append((src, dst))
        if not new:
            break
        path |= {src: [*path[dst], src] for src, dst in new}
        front = [src for src, _ in new]
    longest = max(len(p) for p in path.values())
    return None, None, longest


def asked(spark, edges, roots, samples, names, levels=6):
    e = spark.createDataFrame(edges, EDGE)
    r = spark.createDataFrame([(x,) for x in roots], "node string")
    s = spark.createDataFrame(samples, "trace string, oid string")
    return {x.sample: x for x in trace_retention(e, r, s, spark.createDataFrame(list(names.items()), CLASS), levels).collect()}


def test_shapes(spark):
    names = {"m": "java.util.HashMap", "n": "java.util.HashMap$Node", "t": "java.util.HashMap$Node[]", "v": "byte[]", "c": "com.acme.Cache", "x": "java.lang.Thread", "a": "byte[]", "b": "byte[]", "l": "byte[]", "w": "byte[]"}
    edges = [
        ("n", "v", "java.util.HashMap$Node.value", "strong", 4), ("t", "n", "[3]", "strong", 3), ("m", "t", "java.util.HashMap.table", "strong", 2), ("c", "m", "static:all", "strong", 1),
        ("c", "a", "static:one", "strong", 5), ("x", "b", "java.lang.Thread.locals", "strong", 6), ("l", "l", "Self.next", "strong", 7), ("c", "w", "com.acme.Cache.soft", "weak", 8),
    ]
    got = asked(spark, edges, ["x", "b"], [(k, k) for k in "vablw"] + [("all", "v"), ("all", "b")], names)
    assert got["v"].path == ["byte[]", "java.util.HashMap$Node.value", "java.util.HashMap$Node[]", "java.util.HashMap.table", "com.acme.Cache.all"]
    assert (got["v"].kind, got["v"].holder, got["v"].level, got["v"].objects) == ("static", "c", 3, ["v", "n", "t", "m"])
    assert (got["a"].kind, got["a"].level, got["a"].path) == ("static", 0, ["byte[]", "com.acme.Cache.one"])
    # a sample that is a root itself comes before what holds it
    assert (got["b"].kind, got["b"].holder, got["b"].path) == ("root", "b", ["byte[]", "a GC root"]) and got["all"].holder == "b"
    # a cycle and a weak reference hold nothing
    assert [(got[k].kind, got[k].path, got[k].partial) for k in "lw"] == [(None, ["byte[]"], False)] * 2
    cut = asked(spark, edges, [], [("v", "v")], names, 2)["v"]
    assert (cut.kind, cut.partial, cut.objects) == (None, True, ["v", "n", "t"])


def test_random_graphs(spark):
    for seed in range(4):
        r = random.Random(seed)
        nodes = [f"o{i:02d}" for i in range(30)]
        names = {x: r.choice(["com.acme.A", "java.util.B", "java.util.B", "java.util.C"]) for x in nodes}
        edges = [(r.choice(nodes), r.choice(nodes), r.choice(["F.a", "F.b", "[0]", "static:s", "<class>"]), r.choice(["strong"] * 5 + ["weak"]), i) for i in range(45)]
        roots = r.sample(nodes, 2)
        samples = [(x, x) for x in r.sample(nodes, 12)]
        got = asked(spark, edges, roots, samples, names)
        strong = {(e[0], e[1]) for e in edges if e[3] == "strong"}
        for name, oid in samples:
            kind, holder, objects = walked(edges, set(roots), [oid], names, 6)
            g = got[name]
            assert g.kind == kind and all((up, low) in strong for low, up in zip(g.objects, g.objects[1:]))
            if kind:
                assert (g.holder, len(g.objects)) == (holder, len(objects)), (seed, name)
            else:
                assert len(g.objects) == objects


def test_nothing_sampled(spark):
    assert asked(spark, [("a", "b", "F.x", "strong", 1)], ["a"], [], {"a": "A"}) == {}


def test_few_classes_come_to_their_objects(spark):
    """All objects of a class, or all files that name one, met in one task."""
    from emberlens.operators import heap as H
    from emberlens.sources import snapshots

    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    o = spark.range(50).selectExpr("concat('o', id) oid", "'c' class_id", "'instance' kind", "16L shallow", "0L length")
    c = spark.createDataFrame([("c", "com.acme.A", None, "app"), ("d", "com.acme.B", None, "web")], "cid string, name string, super string, loader string")
    d = H.loaders(o, c)
    assert "broadcast" in plan(d)
    assert sorted(map(tuple, d.collect())) == [("app", 1, 50, 800), ("web", 1, 0, 0)]
    s = spark.range(30).selectExpr("concat('/', id) path", "'package a; import b.Util; class X { void f() { new Util(); } }' source")
    r = snapshots.references(s, spark.createDataFrame([("b.Util",)], "class_name string"))
    assert "broadcast" in plan(r)
    assert {(x.class_name, x.kind) for x in r.collect()} == {("b.Util", "new")} and r.count() == 30
