from collections import Counter

from emberlens.operators import baseline as B
from emberlens.operators import detect as D
from emberlens.operators import segment as S
from emberlens.sources import synthetic as Y


def found(spark, s):
    c = s.config()
    eps = S.episodes(S.entry_marker(Y.records(spark, s), c.entry_sites, c.terminal_sites))
    return D.findings(B.clustered(eps, c.signature_k, c.min_cluster_size), c)


def test_detectors_find_what_was_planted_and_nothing_else(spark):
    s = Y.Scenario(4_000, threads=7, rare=40, seed=3)
    planted = {(r.flow_key, r.ep, r.type, r["index"]) for r in Y.truth(spark, s).collect()}
    assert len(planted) > 60 and len({(t, i) for _, _, t, i in planted}) > 6
    assert {(r.flow_key, r.ep, r.type, r["index"]) for r in found(spark, s).collect()} == planted
    assert found(spark, Y.Scenario(2_000, rare=0)).count() == 0


def test_records_are_functions_of_their_numbers(spark):
    s = Y.Scenario(300, threads=4, seed=9)
    rows = Y.records(spark, s).collect()
    assert sorted(rows) == sorted(Y.records(spark, s).repartition(7).collect())
    assert sorted(rows) != sorted(Y.records(spark, Y.Scenario(300, threads=4, seed=10)).collect())
    # time goes on within a thread
    for key in {r.flow_key for r in rows}:
        mine = sorted((r.o1, r.o2, r.ts_ms) for r in rows if r.flow_key == key)
        assert [m[2] for m in mine] == sorted(m[2] for m in mine)
    shapes = Counter(r.shape for r in Y.episodes(spark, s).collect())
    assert set(shapes) == set(Y.SHAPES) and min(shapes.values()) > 30
