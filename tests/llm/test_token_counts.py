import random
from pathlib import Path

import pytest

from emberlens.llm.token_counts import VOCABULARY, CountTree, Encoder, build_trees, count_tokens, edit_trees, revision
from pyspark.sql import functions as F

ALPHABET = "ab'sStlvremd  \t\n\r\x1c\xa0é9²Ⅷ½_.,-!日"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Path(VOCABULARY).read_bytes())


def revise(text, at, drop, insert):
    at = min(max(at, 0), len(text))
    return text[:at] + insert + text[at + drop :]


def test_tree_follows_random_edits(encoder):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    for _ in range(400):
        text = word(rng.choice([0, 1, 3, 40, 900])) + rng.choice(["", " " * 300, "x" * 400, " the words go on" * 40])
        tree = CountTree(text, encoder)
        assert tree.n_tokens == len(encoder.bpe.encode_ordinary(text))
        for _ in range(6):
            at, drop, insert = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 2, 7, 60, 400, 2000]), word(rng.choice([0, 0, 1, 2, 5, 50]))
            text = revise(text, at, drop, insert)
            tree.edit(at, drop, insert)
            assert tree.text == text
            assert tree.n_tokens == len(encoder.bpe.encode_ordinary(text)), (text, at, drop, insert)
            assert [n for g in tree.chars for n in g] == [len(p) for p in encoder.pieces(text)]


def test_an_edit_encodes_few_pieces_again(encoder):
    text = "some ordinary words follow each other here. " * 2000
    tree = CountTree(text, encoder)
    before = tree.encoded
    tree.edit(40_000, 3, "xyz")
    assert tree.encoded - before < 12


def test_large_insertions_rebuild_the_groups(encoder):
    tree = CountTree("start", encoder)
    tree.edit(5, 0, " more words" * 5000)
    assert tree.n_tokens == len(encoder.bpe.encode_ordinary(tree.text))


def test_counts_of_odd_rows(spark, encoder):
    d = spark.createDataFrame([(1, "a few words, it's", 7), (1, "a few words, it's", 7), (None, "x" * 5000, 7), (2, None, 7), (3, "", 7)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_chars): r for r in count_tokens(d, revision(F.col("text"))).collect()}
    assert count_tokens(d).count() == 5
    assert got[(2, 0)].n_tokens == 0 and got[(2, 0)].n_edits == 0
    text = "a few words, it's"
    for at, drop, insert in ((4, 9, " revised it's"), (8, 0, "\n\n Updated in 2024.\n"), (12, 17, "")):
        assert got[(1, 17)].n_tokens == len(encoder.bpe.encode_ordinary("a few words, it's"))
    assert got[(None, 5000)].n_chars_edited == 5000 - 9 + 13 + 20 - 17
    assert count_tokens(d.limit(0)).count() == 0


def test_stored_trees_take_one_revision_after_the_other(spark, encoder, tmp_path):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    now = {i: word(rng.choice([0, 5, 300, 3000])) for i in range(20)}
    trees = build_trees(spark.createDataFrame(list(now.items()), "doc_id int, text string"))
    for k in range(3):
        trees.write.parquet(f"{tmp_path}/{k}")
        edits = {i: [(rng.randint(0, 3000), rng.choice([0, 3, 40]), word(6)) for _ in range(3)] for i in now if rng.random() < 0.7}
        table = spark.createDataFrame(list(edits.items()), "id int, edits array<struct<at:int,drop:int,insert:string>>")
        stored = spark.read.parquet(f"{tmp_path}/{k}")
        was = {r.id: r for r in stored.collect()}
        got = edit_trees(stored, table).collect()
        for r in got:
            for e in edits.get(r.id, []):
                now[r.id] = revise(now[r.id], *e)
            pieces = encoder.pieces(now[r.id])
            assert (r.text, r.chars, r.tokens) == (now[r.id], [len(p) for p in pieces], encoder.tokens(pieces))
            assert (r.n_tokens, r.n_tokens_edited) == (sum(was[r.id].tokens), sum(r.tokens))
            assert r.id in edits or r.n_pieces_encoded_again == 0
        trees = edit_trees(stored, table).select("id", "text", "chars", "tokens")
        assert len(got) == 20
