"""The index of trigrams against the plain search."""

import random

import pytest

from emberlens.operators import search_index as X
from emberlens.operators.logs import search


def made(spark, rows):
    return spark.createDataFrame(rows, "id long, ts timestamp, level string, message string, extra int")


def test_random_needles_give_the_pages_of_the_scan(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 64)
    r = random.Random(3)
    words = ["alpha", "beta", "ÄÖÜ", "Straße", "pay", "\U0001f600x", "a\\b", "100%", "under_score"]
    rows = [(i, None, r.choice(["INFO", "ERROR"]), " ".join(r.choices(words, k=r.randint(0, 6))), i) for i in range(1, 700)]
    rows += [(700, None, "INFO", None, 1), (701, None, "INFO", "x" * 2000 + "Needle" + "y" * 2000, 1), (701, None, "ERROR", "needle twice", 2), (702, None, "INFO", "ab", 1)]
    e = made(spark, rows)
    index = X.build(e)
    for text, filters, after, limit in [("alpha beta", None, 0, 50), ("ß", None, 0, 20), ("äöü pay", {"level": "ERROR"}, 100, 5), ("needle", None, 0, 10), ("\U0001f600x", None, 300, 500), ("100% A", None, 0, 900), ("a\\b", None, 690, 900), ("nowhere", None, 0, 9), ("ab", None, 698, 9), ("lpha bet", None, -5, 900)]:
        plain = [tuple(x) for x in search(e, filters, text, after=after, limit=limit).collect()]
        got = [tuple(x) for x in X.indexed_search(index, spark, text, filters, after=after, limit=limit).select(*e.columns).collect()]
        assert sorted(got, key=repr) == sorted(plain, key=repr), text


def test_few_rows_are_left_and_only_their_blocks_are_read(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 64)
    e = made(spark, [(i, None, "INFO", f"request {i} served by shop", 0) for i in range(5000)])
    index = X.build(e)
    assert [r.id for r in X.candidates(index, spark, "request 4321").collect()] == [4321]
    assert X.candidates(index, spark, "served by").count() == 5000
    assert X.candidates(index, spark, "served by", 4990).count() == 9
    # beyond the blocks that are named the join alone leaves the same rows
    monkeypatch.setattr(X, "NAMED_BLOCKS", 1)
    assert [r.id for r in X.indexed_search(index, spark, "served by", after=4000, limit=3).collect()] == [4001, 4002, 4003, 4004]


def test_nothing_indexed(spark):
    index = X.build(made(spark, []))
    assert X.indexed_search(index, spark, "needle").collect() == [] and X.indexed_search(index, spark, "n").collect() == []
    with pytest.raises(ValueError):
        X.candidates(index, spark, "ab")


def test_trigrams(spark):
    long = "".join(random.Random(1).choices("abcdefg", k=3000))
    d = spark.createDataFrame([(t,) for t in (None, "", "ab", "abc", "ABCabc", "xyz" * 90, long, long[:258], long[:259])], "t string")
    for r in d.select("t", X.trigrams(d.t).alias("g")).collect():
        assert sorted(r.g) == X.grams_of(r.t or "") and len(set(r.g)) == len(r.g)
