import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from emberlens.llm.components import components
from emberlens.llm.jaccard_join import frequent_prints, jaccard_components, one_of_each
from emberlens.llm.shingles import chunks_of, hash_shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    """{(id, text): (n, component)} by comparing all pairs of ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i) if s else i) for i, s in sets]


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 or not rows:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 30, 80, 200]))]
        elif kind < 0.6:
            words = list(rng.choice(rows)[1].split()) or ["x"]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.8:
            words = passage + [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 40]))]
        else:
            words = list(passage)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    return rows


@pytest.mark.parametrize(("seed", "frequent"), [(1, 64), (2, 3), (3, 1)])
def test_components_are_those_of_all_pairs(spark, seed, frequent):
    rows = corpus(seed)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(d, frequent=frequent).collect()}
    assert got == {i: (n, c) for i, n, c in brute(rows)}


def test_shuffled_id_lists_give_the_same(spark):
    rows = corpus(4, 80)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(d, broadcast_ids=0, frequent=5).collect()}
    assert got == {i: c for i, _, c in brute(rows)}


@pytest.mark.parametrize("how", [{"split": 2, "frequent": 2}, {"split": 5, "frequent": 3, "broadcast_ids": 0, "piece": 3}])
def test_salted_shingles_and_pieces_give_the_same(spark, how):
    rows = corpus(5)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(d, **how).collect()}
    assert got == {i: c for i, _, c in brute(rows)}


def test_gaps_of_prints_count_as_they_are(spark):
    rows = [(" ".join(f"p{i}x{k % 7}" for k in range(4)),) for i in range(5) for _ in range(i + 1)]
    prints, n = frequent_prints(spark.createDataFrame(rows, "text string").repartition(3), 4, 8, 2, 100)
    assert sorted(n) == [2, 3, 4, 5] and list(prints) == sorted(prints)


def test_long_words_are_told_apart():
    a = "ab"
    for _ in range(10):  # a pair of words on which polynomials modulo 2**64 fall together
        a += a.translate(str.maketrans("ab", "ba"))
    texts = [a, a.translate(str.maketrans("ab", "ba"))]
    h = [hash_shingles(raw, bounds, 4)[0] for _, raw, bounds in chunks_of(pa.array(texts))][0]
    assert len(h) == 2 and h[0] != h[1]


def test_odd_rows(spark):
    long = " ".join(f"a{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, long), (8, long + " end"), (9, "one two"), (9, "one two"), (None, "one two"), (10, "a b c d e"), (10, "p q r s t"), (11, "P q r s t"), (12, "ÀB cd ef gh"), (13, "àb cd ef gh")]
    d = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, n long, rep int".replace("n long", "n string"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(d).collect())
    assert got == Counter(brute(rows))
    kept = one_of_each(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 10, 12, 13)] + [(True, 0)]
    assert jaccard_components(d.limit(0)).count() == 0 and one_of_each(d.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(d).collect()}
    assert got == {i: c for i, _, c in brute(rows)}


def test_hashing_sees_texts_apart():
    texts = ["a b c d", "a b c d e", "", None, "B", "x", "a b c", "a B  c\nd", "dé fg", "a b c d"]
    seen = defaultdict(set)
    for first, raw, bounds in chunks_of(pa.array(texts)):
        h, at = hash_shingles(raw, bounds, 4)
        for i in range(len(bounds) - 1):
            for x in h[at[i] : at[i + 1]]:
                seen[x].add(first + i)
    assert sorted(map(sorted, seen.values())) == [[0, 1, 7, 9], [1], [4], [5], [6], [8]]
    assert [len(shingles(t)) for t in texts] == [np.sum([i in s for s in seen.values()]) for i in range(len(texts))]


def test_contraction_finds_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 380)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
