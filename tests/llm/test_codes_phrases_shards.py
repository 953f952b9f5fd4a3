import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlens.llm import phrases
from emberlens.llm.hilbert_shards import hilbert_index, shard_boxes, shard_documents, shards_meeting, write_shards
from emberlens.llm.lookup import look_up
from emberlens.llm.phrases import Levels, count_block, mine_phrases
from emberlens.llm.vector_codes import Codebooks, assign, coded_with_labels, compress


# ---- vector codes


def plain_lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return Counter()
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    whole = [[int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in [*v, *[0.0] * (width - len(v))]] for _, v, _ in kept]
    step = width // parts
    cut = [[tuple(w[p * step : (p + 1) * step]) for p in range(parts)] for w in whole]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, list(kept[r][1])))[:entries]
    books = [[cut[r][p] for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, part: min(range(len(books[p])), key=lambda e: (far(part, books[p][e]), e))
    for _ in range(rounds):
        own = [[near(p, c[p]) for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o[p] == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    own = [[near(p, c[p]) for p in range(parts)] for c in cut]
    error = [min(sum(far(c[p], books[p][o[p]]) for p in range(parts)), 2**63 - 1) for c, o in zip(cut, own)]
    labels = Counter()
    for (_, _, lab), e in zip(kept, error):
        labels[lab] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for e in o), e, min(labels[lab], 2**63 - 1), digest) for (i, _, lab), o, e in zip(kept, own, error))


@pytest.mark.parametrize("kind", ["spread", "ties", "large", "few"])
def test_codes_are_those_of_plain_lloyd(spark, kind):
    rng = np.random.default_rng(5)
    n = 9 if kind == "few" else 400
    size = {"large": 1e30}.get(kind, 1.0)
    make = (lambda: [float(x) for x in rng.integers(-2, 3, 16) / 4096]) if kind == "ties" else (lambda: [float(x) for x in rng.normal(0, size, 16)])
    rows = [(i, make(), int(rng.integers(0, 4))) for i in range(n)]
    rows += [(3, rows[0][1], None), (3, rows[5][1], None), (None, rows[1][1], 2), (7_000, None, 1), (7_001, [float("nan")] * 16, 1), (7_002, [float("inf"), 1.0], 1), (7_003, [1.0, None], 1), (7_004, [], 0), (7_005, [0.25] * 13, None)]
    rows += [rows[2]] * 30
    d = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<double>, label int, code string, error double").repartition(5)
    got = coded_with_labels(d)
    assert got.columns[:5] == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == plain_lloyd(rows)
    assert coded_with_labels(d.limit(0)).count() == 0
    assert coded_with_labels(d.where("embedding is null")).count() == 0


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(-40_000, 40_000, (12, 4))
    x = np.repeat(centres, 100, axis=0)[:, None, :] + rng.integers(-900, 900, (1200, 1, 4))
    books = Codebooks(x[::100][:, 0][None].astype(object))
    state, scans = (None, None, None), []
    for _ in range(6):
        *state, n = assign(x, books, *state)
        plain = ((x[:, 0, None, :] - books.entries[0].astype(np.int64)[None]) ** 2).sum(-1).argmin(1)
        assert (state[0][:, 0] == plain).all()
        scans.append(n)
        entries = books.entries.copy()
        for e in range(12):
            if (plain == e).any():
                entries[0, e] = x[plain == e, 0].sum(0) // int((plain == e).sum())
        books = books.moved_to(entries)
    assert scans[0] == 1200 and sum(scans[1:]) < 600


def test_other_parts_and_entries(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 12)], i % 3) for i in range(200)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    codes, books = compress(d, parts=3, entries=5, rounds=4)
    want = {r[0]: (r[1], r[2]) for r in plain_lloyd(rows, 3, 5, 4)}
    assert {r.vec_id: (r.code, r.error) for r in codes.collect()} == want and books.entries.shape == (3, 5, 4)
    with pytest.raises(ValueError):
        compress(d, entries=300)


def test_lookups_of_hot_and_other_keys(spark):
    d = spark.createDataFrame([(i, ("hot", None, "lost")[i % 3] if i < 240 else f"k{i}", i % 7) for i in range(300)], "i long, k string, x long")
    known = spark.createDataFrame([("hot", 1), (None, 2), ("cold", 3)] + [(f"k{i}", i) for i in range(250, 320)], "k string, v int")
    for how in ("left", "inner"):
        broad, hot, cold = (sorted(((r.i, r.x, r.v) for r in look_up(d, known, ["k"], how, limit=n, hot_keys=h).collect()), key=str) for n, h in ((100, 10), (0, 10), (0, 1)))
        assert broad == hot == cold and len(hot) == (300 if how == "left" else 210)
        assert dict((i, v) for i, _, v in hot)[1] == 2


# ---- phrases


def plain_phrases(rows, least=10, longest=3, top=2000, cover=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered[p[i : i + k]], a)
        found = []
        for p, a in cands.items():
            if p not in covered or 100 * covered[p] < cover * a:
                score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "é", "Éa", "ha", "new", "york", "city", "a b", "x-1", "\U0001f600"]
    gaps = [" "] * 8 + ["\t", "  ", ", ", ". ", "\n", ":", "!?", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), ("fr", " \t.,"), ("en", "ha " * 500), ("xx", "only once here"), *[("en", "new york city new york")] * 40]


@pytest.mark.parametrize("exact", [(1 << 20, 1 << 22), (0, 0), (1 << 20, 0)])
def test_phrases_match_plain_counting(spark, exact):
    rows = corpus(1)
    d = spark.createDataFrame([(i, *r, 1, "x") for i, r in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(4)
    got = mine_phrases(d, exact=exact)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows))
    assert sorted(map(tuple, mine_phrases(d, least=20, longest=4, top=7, cover_percent=80).collect())) == sorted(plain_phrases(rows, 20, 4, 7, 80))
    assert mine_phrases(d.limit(0)).count() == 0


def test_long_texts_are_counted_across_blocks(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 7)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 11)
    rows = [(r[0] or "und", r[1]) for r in corpus(2, 80)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())], ["lang", "text"])
    for k in (1, 2, 3):
        got = Counter()
        for b in phrases._spelt(k, None)(iter([batch])):
            for r in b.to_pylist():
                got[r["lang"], r["phrase"]] += r["n"]
        want = Counter()
        for lang, text in rows:
            for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").encode().lower().decode()):
                words = re.findall("[^\x20\x09]+", piece)
                want.update((lang, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
                if k == 1 and words:
                    want[lang, ""] += len(words)
        assert {k_: v for k_, v in got.items() if v} == dict(want)


def test_only_phrases_with_frequent_parts_are_counted(spark):
    known = phrases.filter_of(spark.createDataFrame([("en", "a b"), ("en", "b c")], "lang string, phrase string"))
    assert known.holds("en", [b"a b", b"b c", b"c d"]).tolist() == [True, True, False]
    assert not known.holds("de", [b"a b"])[0]
    tokens = [b"a", b"b", b"c", b"d", b".", b"a", b"b"]
    assert count_block(tokens, 3, "en", known)[0] == [b"a b c"]
    words = spark.createDataFrame([(x, w) for x in ("en", "de") for w in "abcd"], "lang string, phrase string").selectExpr("xxhash64(lang, phrase) AS h", "lang", "phrase").toArrow()
    levels = Levels(words)
    assert levels.clear() and (levels.numbers("fr", [b"a"]) == -1).all()
    pairs, counts = levels.count(tokens, 2, "en")
    spelt = dict(zip(levels.spell(pairs, 2)[1].to_pylist(), counts.tolist()))
    assert spelt == {"a b": 2, "b c": 1, "c d": 1}
    levels.codes.append(np.sort(pairs[[p in ("a b", "b c") for p in spelt]]))
    triples, _ = levels.count(tokens, 3, "en")
    lang, names = levels.spell(triples, 3)
    assert (lang.to_pylist(), names.to_pylist()) == (["en"], ["a b c"])


# ---- shards


def test_the_curve_visits_each_cell_once_by_single_steps(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = spark.range(side**n).select(*[(F.shiftright("id", bits * k).bitwiseAND(F.lit(side - 1))).cast("int").alias(f"c{k}") for k in range(n)])
        rows = [tuple(r) for r in cells.select(hilbert_index([F.col(f"c{k}") for k in range(n)], bits).alias("h"), "*").orderBy("h").collect()]
        assert [r[0] for r in rows] == list(range(side**n))
        assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:])) == 1 for x, y in zip(rows, rows[1:]))


def shard_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(["same text"] * 3 + ["t" * rng.randint(0, 50), "é" * 3, None, ""]), rng.choice(["en", "en", "de", None]), rng.choice(["s1"] * 4 + ["s2", "s3", None]), rng.choice([None, rng.randint(0, 900)])) for i in range(531)]
    return rows + [(5, "same text", "en", "s1", 9)] * 60 + [(None, "n", "en", "s1", 1)] * 2 + [(900, "long " * 200_000, "fr", "s9", 1_000_000)]


@pytest.mark.parametrize("shards", [8, 1000])
def test_shards_are_runs_of_equal_counts(spark, shards):
    rows = shard_rows()
    d = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, curve string").repartition(6)
    got = shard_documents(d, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    ends = sorted((r.shard, r.slot, r.curve) for r in got)
    assert [x[2] for x in ends] == sorted(x[2] for x in ends)
    assert shard_documents(d.limit(0), shards).count() == 0
    again = shard_documents(d.repartition(3), shards).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(again, key=key)


def test_written_shards_are_whole_and_prune(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"t{i}", f"l{rng.randrange(8)}", f"s{rng.randrange(20):02d}", rng.randrange(10_000)) for i in range(4_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    boxes = write_shards(d, str(tmp_path / "a"), 64)
    back = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(map(tuple, back.select(*d.columns).collect())) == sorted(rows)
    for ranges in ({"lang": ("l2", "l2")}, {"source": ("s03", "s04")}, {"n_chars": (100, 900)}):
        c, (low, high) = next(iter(ranges.items()))
        need = {r.shard for r in back.where(F.col(c).between(low, high)).select("shard").distinct().collect()}
        meeting = {r.shard for r in shards_meeting(boxes, ranges).collect()}
        assert need <= meeting and len(meeting) < 40, (c, len(meeting))
    clash = d.withColumn("shard", F.lit("mine"))
    write_shards(clash, str(tmp_path / "b"), 4)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert sorted(map(tuple, back.select("row.*").collect())) == sorted((*r, "mine") for r in rows)
    assert shard_boxes(back).count() == 4
