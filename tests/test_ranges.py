"""Running values in ranges against plain code and against windows; what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from emberlens.operators import baseline as B
from emberlens.operators import gc as GC
from emberlens.operators import logs as L
from emberlens.operators import segment as S
from emberlens.operators.ranges import first, last, percentiles, running, total


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables are cut into several ranges as well."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_values(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, rng.randint(-5, 5)])) for i in range(2_000)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "k string, i long, v long").repartition(6)
    folds = {"before": total(F.col("v"), inclusive=False), "upto": total(F.col("v")), "held": last(F.col("v")), "now": last(F.col("v"), inclusive=True), "head": first(F.col("v"))}
    want, state = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        s, held, head = state.get(k, (0, None, None))
        now = held if v is None else v
        head = v if head is None else head
        want[i] = (k, v, s, s + (v or 0), held, now, head)
        state[k] = (s + (v or 0), now, head)
    for limit in (10_000, 0):
        got = running(d, ["k"], ["i"], folds, limit)
        assert got.columns == ["k", "i", "v", *folds]
        assert {r.i: (r.k, r.v, r.before, r.upto, r.held, r.now, r.head) for r in got.collect()} == want
        assert running(d.limit(0), ["k"], ["i"], folds, limit).count() == 0
    alone = running(d, [], ["i"], {"n": total(F.lit(1))})
    assert {r.i: r.n for r in alone.collect()} == {i: i + 1 for i in range(2_000)}


def test_percentiles_by_places(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, rng.random() * 100, 5.0])) for _ in range(900)] + [("one", 3.5)]
    d = spark.createDataFrame(rows, "k string, v double")
    shares = {"q0": 0.0, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    small, large = ({r.k: tuple(r[1:]) for r in percentiles(d, ["k"], "v", shares, limit).collect()} for limit in (10_000, 0))
    assert set(small) == set(large) == {"a", "b", None, "one"}
    for k in small:
        assert small[k] == pytest.approx(large[k], abs=1e-9)


def test_one_flow_of_all_records_is_cut(spark):
    rng = random.Random(4)
    sites, t, rows = ["in", "work", "work", "out", "idle"], 0, []
    for i in range(1_500):
        t += rng.choice([1, 20, 20, 900])
        rows.append(("f" if i % 50 else "g", rng.choice([None, t]), rng.choice(sites), "INFO", False, "T", i, 0))
    d = spark.createDataFrame(rows, "flow_key string, ts_ms long, call_site string, level string, has_stack boolean, thread_id string, o1 long, o2 long").repartition(5)
    for cut in (lambda n: S.idle_gap(d, 500, ["out"], n), lambda n: S.entry_marker(d, ["in"], ["out"], n), lambda n: S.correlation(d, ["out"], n)):
        whole, parts = (sorted(map(str, S.episodes(cut(n)).collect())) for n in (10_000, 0))
        assert whole == parts and len(whole) > 1
    # of ranges that hold parts of one flow there are many
    parts = running(d, ["flow_key"], ["o1", "o2"], {"n": total(F.lit(1))}, 0).where("flow_key = 'f'").select(F.spark_partition_id().alias("p")).distinct()
    assert parts.count() > 1


def test_large_logs_are_cut(spark):
    rng = random.Random(5)
    lines, t = [], 0.0
    for log in ("x", "y"):
        for i in range(300):
            t += rng.random()
            lines.append((log, i + 1, f"[{t:.3f}s][info][gc] GC({i}) Pause {rng.choice(['Young (Normal) (G1 Evacuation Pause)', 'Full (System.gc())'])} {rng.randint(200, 400)}M->{rng.randint(50, 200)}M(512M) {rng.random() * 90:.3f}ms"))
    d = spark.createDataFrame(lines, "log string, line_no long, line string")
    for f in (GC.pauses, GC.allocation, GC.baseline_reset):
        whole, parts = ({r[0]: tuple(r) for r in (f(GC.events(d, n), limit=n) if f is not GC.pauses else f(GC.events(d, n), None, n)).collect()} for n in (10_000, 0))
        assert set(whole) == {"x", "y"}
        for k in whole:
            assert whole[k][1:] == pytest.approx(parts[k][1:]), f
    assert sorted(map(str, GC.events(d, 10_000).collect())) == sorted(map(str, GC.events(d, 0).collect()))


def test_restarts_as_of_captures(spark):
    rng = random.Random(6)
    at = lambda s: None if s is None else f"2026-01-01 00:{s // 60:02d}:{s % 60:02d}"
    events = [(i, rng.choice([None, rng.randrange(600)])) for i in range(80)]
    marks = [(i, rng.choice(["oom", "server_start", "other"])) for i, _ in events]
    caps = [(f"c{i}", rng.randrange(600)) for i in range(60)] + [("none", None)]
    caps += [(f"t{i}", s) for i, (_, s) in enumerate(events) if s is not None][:20]
    e = spark.createDataFrame([(i, at(s)) for i, s in events], "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    m = spark.createDataFrame(marks, "event_id long, kind string")
    c = spark.createDataFrame([(i, at(s)) for i, s in caps], "capture_id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    when, want = dict(events), {}
    for cid, s in caps:
        oom = [when[i] for i, k in marks if k == "oom" and when[i] is not None and s is not None and when[i] <= s]
        start = [when[i] for i, k in marks if k == "server_start" and when[i] is not None and s is not None and when[i] < s]
        want[cid] = (max(oom, default=None), bool(oom and start and max(start) > max(oom)))
    got = L.restarts(m, e, c)
    assert {r.capture_id: (None if r.last_oom is None else r.last_oom.minute * 60 + r.last_oom.second, r.restarted) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


def exchanges(d):
    return d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_of_large_flows_are_moved_once_after_their_sort(spark):
    rows = [("f" if i % 9 else None, "T", 10 * i, "in" if i % 5 == 0 else "out" if i % 5 == 3 else "work", "INFO", False, i, 0) for i in range(400)]
    d = spark.createDataFrame(rows, "flow_key string, thread_id string, ts_ms long, call_site string, level string, has_stack boolean, o1 long, o2 long")
    assert exchanges(running(d, ["flow_key"], ["o1"], {"n": total(F.lit(1)), "held": last(F.col("ts_ms"))}, 0)) == 1
    cut, whole = (S.entry_marker(d, ["in"], ["out"], limit) for limit in (0, 10_000))
    assert exchanges(cut) == 1
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect())) and cut.count() > 200
    # few clusters come to their episodes
    assert exchanges(B.clustered(S.episodes(whole), 2, 1)) == 0
