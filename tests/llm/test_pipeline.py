import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from emberlens.llm.language_id import identify_documents
from emberlens.llm.mixing import mix
from emberlens.llm.secret_ledger import redact_documents
from test_jaccard_join import brute, shingles


@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = {"en": "the of and thing house water over with that word".split(), "de": "der und über straße haus wasser nicht mit das wort".split()}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) + str(rng.randrange(90)) for _ in range(n))
    item = text("en", 30)
    rows = [(i, text(k, 60), k, f"s{i % 4}") for i in range(80) for k in [rng.choice(["en", "de"])]]
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[4][1] + " more", "de", "s1"), (102, "12 34", "en", "s2"), (103, None, "en", "s2"), (104, text("en", 50) + " " + item, "en", "s3"), (105, "secret=abcdefgh99 " + text("en", 40), "en", "s3")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, item


def test_stages_do_what_plain_code_does(spark, sf_dir):
    path, rows, item = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    known = {r.doc_id for r in identify_documents(docs).where("lang_pred <> 'und'").collect()}
    left = [r for r in rows if r[0] in known]
    assert {r[0] for r in rows} - known == {102, 103}
    parts = {i: c for i, _, c in brute([(r[0], r[1]) for r in left])}
    left = [r for r in left if parts[r[0]] == r[0]]
    grams = lambda t: shingles(t, 5)
    left = [r for r in left if 10 * len(grams(r[1]) & grams(item)) < 8 * len(grams(item))]
    want = spark.createDataFrame([(*r, len(r[1])) for r in left], docs.schema)
    masked = redact_documents(want)
    assert masked.where("doc_id = 105").first().text.startswith("[secret] ")
    want = mix(masked, spark.read.parquet(f"{path}/labels.parquet")).where("taken > 0")
    got = corpus_pipeline.run(spark, path)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    ids = {r.doc_id for r in got.collect()}
    assert not ids & {100, 101, 102, 103, 104}


def test_stages_take_odd_tables(spark, sf_dir):
    path, rows, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = spark.createDataFrame([(None, "text without id", None, None, None), (3, "", "en", "s0", 0), (3, "", "en", "s0", 0), (4, "ABC def", None, None, 7)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name
        out = stage(spark, odd, path)
        assert name == "mix" or out.columns == docs.columns
        assert out.count() <= 4


def test_stages_carry_columns_of_any_name(spark, sf_dir):
    path, _, _ = sf_dir
    names = ["_blob", "blob", "spans", "id", "c0", "n", "hub", "lang_pred", "size", "taken", "h", "words"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for n in names:
        docs = docs.withColumn(n, F.lit(f"is {n}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(names).collect()} == {tuple(f"is {n}" for n in names)}, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, path).count() > 0


def test_missing_languages_are_filled(spark, sf_dir):
    path, rows, _ = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    unlabelled = docs.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang")))
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, unlabelled, path).collect()}
    assert got == {r[0]: r[2] for r in rows if r[0] not in (102, 103)}


def test_near_copies_go_from_a_similarity_of_eight_tenths(spark):
    words = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    base, other = words(0, 304), words(1, 304)
    rows = [(1, " ".join(base)), (2, " ".join(base + words(2, 66))), (3, " ".join(other)), (4, " ".join(other + words(3, 80)))]
    j = lambda a, b: len(a & b) / len(a | b)
    near, far = (j(shingles(rows[k][1], 5), shingles(rows[k + 1][1], 5)) for k in (0, 2))
    assert 0.815 < near < 0.825 and 0.785 < far < 0.8
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4]


def test_registered():
    q = __spark_entry__.queries()
    assert "pipeline" in q and all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(q)
