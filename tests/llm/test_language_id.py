import math
import random

from pyspark.sql import functions as F

from emberlens.llm.language_id import BLOCK, CrossParser, Training, fold, identify, identify_documents, keep_identified, learn, suffix_automaton

WORDS = {"en": "the of and thing house water over with that".split(), "de": "der und über straße haus wasser nicht mit das".split(), "fr": "le la été avec maison une eau pas où".split()}


def sample(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def phrases(train, text):
    """Greedy longest matches by plain search."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in train:
            k += 1
        n += 1
        at += k
    return n


def test_automaton_knows_exactly_the_substrings():
    text = "abracadabra banana abba"
    auto = suffix_automaton(text)
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("abcdnr ") for _ in range(rng.randint(1, 6)))
        state = 0
        for c in s:
            state = auto[state].get(c)
            if state is None:
                break
        assert (state is not None) == (s in text)


def test_parser_counts_phrases_as_plain_search_does():
    training = Training(tuple((k, 5, fold(sample(k, 300, 1))) for k in WORDS))
    parser = CrossParser(training)
    texts = [sample(k, n, s) for s, k in enumerate(WORDS) for n in (1, 2, 7, 400)] + ["zzz qqq", "12 über!! Water", "a", "", "!!", "  the  THE "]
    best, score = parser.parse(texts)
    for i, t in enumerate(texts):
        folded = fold(t)
        if not folded.strip():
            assert best[i] == -1 and score[i] == 0
            continue
        costs = [phrases(tr, folded) * math.log2(len(tr)) for _, _, tr in training.languages]
        assert costs[best[i]] == min(costs)
        low, other = sorted(costs)[:2]
        assert abs(score[i] - (1 - low / other)) < 1e-9


def test_no_phrase_ends_at_a_block(spark):
    rng = random.Random(3)
    own = fold(sample("en", 3000, 5))
    parser = CrossParser(Training((("en", 1, own), ("de", 1, fold(sample("de", 400, 6))))))
    texts = [own[BLOCK // 2 : BLOCK * 7], own[3:700] + own[1200 : 1200 + 3 * BLOCK]] + [own[i : i + rng.randrange(1, 3000)] + own[j:] for i, j in [(rng.randrange(9000), rng.randrange(9000)) for _ in range(6)]]
    folded = [fold(t) for t in texts]
    best, score = parser.parse(texts)
    for i, t in enumerate(folded):
        costs = sorted(phrases(tr, t) * math.log2(len(tr)) for tr in (own, fold(sample("de", 400, 6))))
        assert best[i] == 0 and abs(score[i] - (1 - costs[0] / costs[1])) < 1e-9


def test_scripts_with_more_letters_than_a_byte():
    rng = random.Random(7)
    letters = {"a": range(0x4E00, 0x4E00 + 1500), "b": range(0x4E00 + 700, 0x4E00 + 3500)}
    text = {k: "".join(chr(rng.choice(r)) for _ in range(9000)) for k, r in letters.items()}
    parser = CrossParser(Training(tuple((k, 1, fold(t)) for k, t in text.items())))
    for k, t in text.items():
        best, _ = parser.parse([t[i : i + 60] for i in range(0, 9000, 90)])
        assert {parser.langs[i] for i in best} == {k}


def test_marks_stay_with_their_letters():
    assert fold("\u0939\u093f\u0928\u094d\u0926\u0940 x") == " \u0939\u093f\u0928\u094d\u0926\u0940 x "
    assert CrossParser(Training((("hi", 1, fold("\u0939\u093f")),))).parse(["\u093f", "\u0939"])[0].tolist() == [-1, 0]


def test_documents(spark):
    rows = [(i, sample(k, 40, i), k, "s") for i in range(120) for k in WORDS if i % 3 == list(WORDS).index(k)]
    odd = [(500, None, "en", "s"), (501, "", "en", "s"), (502, "12 34 !!", "de", "s"), (None, sample("fr", 30, 9), None, "s"), (3, sample("en", 30, 7), None, None), (3, sample("en", 30, 7), None, None), (504, sample("de", 20_000, 3), "de", "s")]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(2))
    got = identify_documents(d).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    want = {r[0]: r[2] for r in rows}
    assert all(by[i].lang_pred == lang for i, lang in want.items() if i != 3)
    assert [by[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and by[500].score == 0
    assert by[None].lang_pred == "fr" and not by[None].held_out and by[504].lang_pred == "de"
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    kept = keep_identified(d)
    assert kept.columns == d.columns and kept.count() == len(rows) + len(odd) - 3
    assert kept.where("doc_id is null").first().lang == "fr"
    assert {r.doc_id for r in keep_identified(d, ("de",)).collect()} == {i for i, lang in want.items() if lang == "de" and i != 3} | {504}
    assert identify_documents(d.limit(0)).count() == 0


def test_nothing_learned(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    none = learn(d.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert none.languages == () and identify(d, none).collect()[0].lang_pred == "und"


def test_ties_go_to_the_label_seen_more():
    parser = CrossParser(Training((("b", 9, " same text "), ("a", 2, " same text "))))
    best, score = parser.parse(["text"])
    assert parser.langs[best[0]] == "b" and score[0] == 0
