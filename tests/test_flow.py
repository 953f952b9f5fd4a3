"""Segmentation against plain state machines, detectors and ranking on small flows, dominators against removal."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlens.config import FlowConfig
from emberlens.operators import baseline as B
from emberlens.operators import detect as D
from emberlens.operators import graph as G
from emberlens.operators import rank as R
from emberlens.operators import segment as S

SCHEMA = "flow_key string, thread_id string, ts_ms long, call_site string, level string, message string, o1 long, o2 long"


def records(spark, flows):
    rows = [(k, k, ts, site, level, "", 0, i) for k, f in flows.items() for i, (ts, site, level) in enumerate(f)]
    return spark.createDataFrame(rows, SCHEMA)


def random_flows(seed):
    rng = random.Random(seed)
    flows = {}
    for k in range(40):
        t, f = 1_000_000, []
        for _ in range(rng.randint(1, 25)):
            t += rng.choice([-50, 0, 10, 100, 101, 900])
            f.append((None if rng.random() < 0.15 else t, rng.choice(["in", "a", "b", "out", None]), rng.choice(["INFO", "error", "ERROR", None]) if rng.random() < 0.1 else "INFO"))
        flows[f"t{k}"] = f
    return flows


def shape(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.flow_key, []).append((r.ep, r.status, list(r.seq)))
    return {k: [(s, q) for _, s, q in sorted(v, key=lambda x: x[0])] for k, v in out.items()}


def status(part, terminals):
    if any((lv or "").upper() == "ERROR" for _, _, lv in part):
        return "ERRORED"
    return "COMPLETED" if any(s in terminals for _, s, _ in part) else "TRUNCATED"


def test_idle_gap_is_the_state_machine(spark):
    flows = random_flows(1)
    got = shape(S.episodes(S.idle_gap(records(spark, flows), 100, ["out"])))
    for k, f in flows.items():
        parts, last = [[]], None
        for r in f:
            if r[0] is not None and last is not None and max(0, r[0] - last) > 100:
                parts.append([])
            parts[-1].append(r)
            last = r[0] if r[0] is not None else last
        assert got[k] == [(status(p, ["out"]), [s for _, s, _ in p if s]) for p in parts]


def test_entry_marker_is_the_state_machine(spark):
    flows = random_flows(2)
    got = shape(S.episodes(S.entry_marker(records(spark, flows), ["in"], ["out"])))
    for k, f in flows.items():
        parts, on = [], None
        for r in f:
            if r[1] == "in":
                on = [r]
                parts.append(on)
            elif on is not None:
                on.append(r)
            if on is not None and r[1] == "out":
                on = None
        assert got.get(k, []) == [(status(p, ["out"]), [s for _, s, _ in p if s]) for p in parts]


def test_correlation_orders_by_time(spark):
    d = records(spark, {"x": [(30, "c", "INFO"), (None, "z", "INFO"), (10, "a", "INFO"), (20, "b", "INFO")]})
    assert shape(S.episodes(S.correlation(d)))["x"] == [("TRUNCATED", ["a", "b", "c", "z"])]


def test_runs_collapse(spark):
    d = records(spark, {"x": [(1, "a", "INFO"), (2, None, "INFO"), (3, "a", "INFO"), (4, "b", "INFO"), (5, "a", "INFO")]})
    r = S.episodes(S.idle_gap(d, 10**6)).collect()[0]
    assert [(x.site, x.first_ms, x.n) for x in r.runs] == [("a", 1, 2), ("b", 4, 1), ("a", 5, 1)]


CLEAN = ["in", "check", "pay", "out"]


def population(spark, odd=()):
    flows = {}
    for i in range(30):
        t = 10_000_000 + 1_000_000 * i
        flows[f"c{i:02}"] = [(t + 100 * k, s, "INFO") for k, s in enumerate(CLEAN)]
    for name, sites, step in odd:
        flows[name] = [(15_000_000 + step * k, s, "INFO") for k, s in enumerate(sites)]
    return S.episodes(S.idle_gap(records(spark, flows), 500_000, ["out"]))


CONFIG = FlowConfig(signature_k=1, min_cluster_size=5, censor_margin_ms=0)


def test_clean_flows_give_no_findings(spark):
    assert D.findings(B.clustered(population(spark), 1, 5), CONFIG).count() == 0


@pytest.mark.parametrize(("sites", "step", "kind", "site", "expected"), [(["in", "check"], 100, "TRUNCATION", "check", "out"), (["in", "check", "refund", "out"], 100, "DIVERGENCE", "refund", "pay"), (CLEAN, 90_000, "TIMING", "check", "in"), ([*CLEAN, "audit"], 100, "DIVERGENCE", "audit", "<end-of-flow>")])
def test_each_defect_is_found(spark, sites, step, kind, site, expected):
    f = D.findings(B.clustered(population(spark, [("odd", sites, step)]), 1, 5), CONFIG)
    assert (kind, site, expected) in {(r.type, r.site, r.expected) for r in f.where("thread_id = 'odd'").collect()}
    assert f.where("thread_id <> 'odd'").count() == 0
    top = R.rank_findings(f, CONFIG).where("rank = 1").collect()
    assert top[0].thread_id == "odd" and 0 < top[0].score <= 3.5


def test_small_clusters_and_edges_are_left_out(spark):
    eps = population(spark, [("odd", ["lone", "x"], 100)])
    assert D.findings(B.clustered(eps, 1, 5), CONFIG).count() == 0
    cut = population(spark, [("odd", ["in", "check"], 100)])
    wide = FlowConfig(signature_k=1, min_cluster_size=5, censor_margin_ms=10**9)
    assert D.findings(B.clustered(cut, 1, 5), wide).count() == 0


def test_configuration_document():
    c = FlowConfig.from_mapping({"segmentation": {"entryCallSites": ["a"], "idleGapMillis": 7}, "ranking": {"weights": {"rarity": 2.0}, "topN": 3}, "baseline": {"window": {"start": 5}}})
    assert (c.entry_sites, c.idle_gap_ms, c.rarity_weight, c.top_n, c.window_start, c.window_end) == (("a",), 7, 2.0, 3, 5, None)


def test_edit_distance(spark):
    d = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], ["x"]), (["a"], ["a"]), (["a", "b"], ["b", "a"])], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(D.edit_distance(F.col("a"), F.col("b"))).collect()] == [1, 1, 0, 2]


def test_edit_distance_of_many_sites(spark):
    rng = random.Random(8)
    long = [f"site{i}" for i in range(1_000)]
    other = long[:]
    for _ in range(40):
        other[rng.randrange(len(other))] = f"new{rng.randrange(500)}"
        del other[rng.randrange(len(other))]
        other.insert(rng.randrange(len(other)), rng.choice(long))
    cases = [(long, other), (long[:400], long[100:400] + long[:100]), (long[:300], long[:299] + ["x"]), ([], long), (long, long)]

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = {r.i: r.n for r in d.select("i", D.edit_distance(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: plain(a, b) for i, (a, b) in enumerate(cases)}


def test_dominators_against_removal():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        e = [(0, 1)] + [(int(a), int(b)) for a, b in rng.integers(0, n, (3 * n, 2)) if rng.random() < 0.5]
        src, dst = np.array([a for a, _ in e]), np.array([b for _, b in e])

        def reached(without, e=e):
            seen, todo = {0}, [0]
            while todo:
                v = todo.pop()
                for a, b in e:
                    if a == v and b not in seen and b != without:
                        seen.add(b)
                        todo.append(b)
            return seen

        idom = G.immediate_dominators(n, src, dst)
        alive = reached(None)
        lost = {v: alive - reached(v) for v in alive if v}
        for v in range(n):
            if v not in alive:
                assert idom[v] == -1
            elif v:
                doms = {u for u in lost if u != v and v in lost[u]} | {0}
                assert idom[v] in doms and all(u == 0 or u == idom[v] or idom[v] in lost[u] for u in doms)


def test_retained_and_reachable(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("e", "c"), ("x", "y")], "src string, dst string")
    r, o = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([(k, 10) for k in "abcdexy"], "oid string, shallow long")
    assert {x.node for x in G.reachable(e, r).collect()} == set("abcde")
    gone = spark.createDataFrame([("b",), ("d",)], "node string")
    assert {x.node for x in G.retained_without(e, r, gone).collect()} == set("bdce")
    got = {x.node: (x.parent, x.retained) for x in G.dominators(o, e, r).collect()}
    assert got == {"0x0": ("0x0", 50), "a": ("0x0", 50), "b": ("a", 10), "d": ("a", 10), "c": ("a", 20), "e": ("c", 10)}
    assert {x.node: x.depth for x in G.distances(e, r).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2, "e": 3}
