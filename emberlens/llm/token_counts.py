"""Token counts that follow edits.

A text is cut into pre-tokens; each is a leaf with its characters and its number of BPE tokens, and
a segment tree over groups of leaves holds sums of both. The trees are kept: a table has the text and
the leaves of each document (``build_trees``), and a revision reads them, applies its edits and gives
the next table (``edit_trees``). An edit is located by descending the character sums. Pre-tokens are
cut again only from the last boundary that the edit cannot have moved, MARGIN characters before it,
until a boundary falls on an old one behind it, from where all cuts are as before; only those pieces
are encoded, and the sums above them updated. Text is kept by groups, so an edit copies its groups.

Defined results: a null text is the empty text, with 0 tokens; very long texts are one tree, in one
task, in time and memory in proportion to the text; edits apply in their order, each to the text that
the last one left, places and lengths being cut to the text; null edits are no edits; rows that repeat
are answered each; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.session import ship_package, write_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No alternative of PATTERN looks more than two characters past the end of its match.
MARGIN = 3
GROUP, LARGEST_GROUP, CACHE = 32, 1024, 500_000
EDITS = "array<struct<at:int,drop:int,insert:string>>"


class Encoder:
    """Pre-token boundaries and cached token numbers of pre-tokens."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.bpe = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cuts = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        return self.cuts.findall(text)

    def tokens(self, pieces: list[str]) -> list[int]:
        known, out = self.known, []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(self.bpe._encode_single_piece(p))
                if len(p) <= 32:
                    if len(known) >= CACHE:
                        known.clear()
                    known[p] = n
            out.append(n)
        return out


class CountTree:
    """Leaves and text in groups, and a binary tree of (characters, tokens) over the groups."""

    def __init__(self, text: str, encoder: Encoder, leaves: tuple[list[int], list[int]] | None = None):
        """leaves: characters and tokens of each leaf, where they are known."""
        self.encoder, self.encoded = encoder, 0
        if leaves is None:
            pieces = encoder.pieces(text)
            leaves = [len(p) for p in pieces], self._encode(pieces)
        self._build(text, *leaves)

    def _encode(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        return self.encoder.tokens(pieces)

    def _build(self, text: str, chars: list[int], tokens: list[int]) -> None:
        self.chars = [chars[i : i + GROUP] for i in range(0, len(chars), GROUP)] or [[]]
        self.tokens = [tokens[i : i + GROUP] for i in range(0, len(tokens), GROUP)] or [[]]
        sizes = [sum(c) for c in self.chars]
        ends = [0, *accumulate(sizes)]
        self.texts = [text[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        self.base = 1 << (len(self.chars) - 1).bit_length()
        self.sum_chars, self.sum_tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        self.sum_chars[self.base : self.base + len(sizes)] = sizes
        self.sum_tokens[self.base : self.base + len(sizes)] = [sum(t) for t in self.tokens]
        for i in range(self.base - 1, 0, -1):
            self._add_up(i)

    def _add_up(self, i: int) -> None:
        self.sum_chars[i] = self.sum_chars[2 * i] + self.sum_chars[2 * i + 1]
        self.sum_tokens[i] = self.sum_tokens[2 * i] + self.sum_tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.sum_tokens[1]

    @property
    def n_chars(self) -> int:
        return self.sum_chars[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def leaves(self) -> tuple[list[int], list[int]]:
        return [c for g in self.chars for c in g], [t for g in self.tokens for t in g]

    def _find(self, place: int) -> tuple[int, int]:
        """The group that holds a character, or the last, and the characters before that group."""
        i, before = 1, 0
        while i < self.base:
            i *= 2
            if place >= before + self.sum_chars[i] and self.sum_chars[i + 1]:
                before += self.sum_chars[i]
                i += 1
        return i - self.base, before

    def edit(self, at: int, drop: int, insert: str) -> None:
        at = min(max(at, 0), self.n_chars)
        drop = min(max(drop, 0), self.n_chars - at)
        shift, chars, n_groups = len(insert) - drop, self.chars, len(self.chars)
        first, before = self._find(max(0, at - MARGIN))
        ends = [before, *accumulate(chars[first], initial=before)][1:]  # boundaries of the group
        keep = max(0, bisect_left(ends, max(0, at - MARGIN + 1)) - 1) if at > MARGIN else 0
        start = ends[keep]
        # the edited text of the groups from the one before the first on, as far as it is needed
        head = "".join(self.texts[max(0, first - 1) : first])
        base, reach, known = before - len(head), first + 1, before + self.sum_chars[self.base + first]
        while reach < n_groups and known < at + drop + MARGIN:
            known += self.sum_chars[self.base + reach]
            reach += 1
        old = head + "".join(self.texts[first:reach])
        text = old[: at - base] + insert + old[at - base + drop :]
        group, place, leaf = first, before, 0  # an old boundary, moved on behind the edit
        new, stop, met = [], start, False
        while not met:
            for m in self.encoder.cuts.finditer(text, stop - base):
                if reach < n_groups and m.end() > len(text) - MARGIN:
                    break  # what follows may change this piece
                new.append(m[0])
                stop = base + m.end()
                if stop - shift < at + drop or stop < at + len(insert):
                    continue
                while group < n_groups and place < stop - shift:
                    if leaf == len(chars[group]):
                        group, leaf = group + 1, 0
                        continue
                    place += chars[group][leaf]
                    leaf += 1
                if place == stop - shift:
                    met = True
                    break
            if not met:
                if reach == n_groups:
                    break
                more = max(1, reach - first)
                text += "".join(self.texts[reach : reach + more])
                reach = min(n_groups, reach + more)
        if not met:
            group, leaf = n_groups - 1, len(chars[-1])
        tail = self.texts[group][sum(chars[group][:leaf]) :]
        tail_chars, tail_tokens = chars[group][leaf:], self.tokens[group][leaf:]
        self.texts[first] = "".join([self.texts[first][: start - before], *new, tail])
        chars[first] = chars[first][:keep] + [len(p) for p in new] + tail_chars
        self.tokens[first] = self.tokens[first][:keep] + self._encode(new) + tail_tokens
        for g in range(first + 1, group + 1):
            self.texts[g], chars[g], self.tokens[g] = "", [], []
        if len(chars[first]) > LARGEST_GROUP:
            self._build(self.text, *self.leaves())
            return
        touched = set()
        for g in range(first, group + 1):
            i = self.base + g
            self.sum_chars[i], self.sum_tokens[i] = len(self.texts[g]), sum(self.tokens[g])
            touched.add(i >> 1)
        while touched and (touched != {0}):
            for i in touched:
                self._add_up(i)
            touched = {i >> 1 for i in touched if i > 1}


@lru_cache(maxsize=2)
def encoder_of(vocabulary: bytes, pattern: str) -> Encoder:
    return Encoder(vocabulary, pattern)


def _ints(lists: list) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *[np.asarray(x, dtype=np.int32) for x in lists]])))


def _build(vocabulary, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary.value, pattern)
        for b in batches:
            chars, tokens = [], []
            for t in b.column("text").to_pylist():
                pieces = encoder.pieces(t or "")
                chars.append([len(p) for p in pieces]), tokens.append(encoder.tokens(pieces))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), _ints(chars), _ints(tokens)], ["id", "text", "chars", "tokens"])

    return run


def _edit(vocabulary, pattern: str, trees_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary.value, pattern)
        for b in batches:
            out: list[tuple[int, ...]] = []
            texts, chars, tokens = [], [], []
            for text, c, t, edits in zip(*[b.column(x) for x in ("text", "chars", "tokens", "edits")], strict=True):
                leaves = c.values.to_numpy().tolist(), t.values.to_numpy().tolist()
                tree = CountTree(text.as_py() or "", encoder, leaves)
                n_chars, before = tree.n_chars, tree.n_tokens
                todo = [e for e in edits.as_py() or [] if e]
                for e in todo:
                    tree.edit(e["at"] or 0, e["drop"] or 0, e["insert"] or "")
                out.append((n_chars, len(leaves[0]), before, len(todo), tree.n_chars, tree.n_tokens, tree.encoded))
                if trees_too:
                    c, t = tree.leaves()
                    texts.append(tree.text if todo or text.is_valid else None), chars.append(c), tokens.append(t)
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(COUNTS)
            kept = [pa.array(texts, pa.string()), _ints(chars), _ints(tokens)] if trees_too else []
            yield pa.RecordBatch.from_arrays([b.column("id"), *kept, *columns], ["id", *(("text", "chars", "tokens") if trees_too else ()), *COUNTS])

    return run


COUNTS = ("n_chars", "n_pieces", "n_tokens", "n_edits", "n_chars_edited", "n_tokens_edited", "n_pieces_encoded_again")
TREE = "text string, chars array<int>, tokens array<int>"


def shared_vocabulary(spark: SparkSession, vocabulary: str):
    """The bytes of a vocabulary file, sent to the executors. A path with a scheme is read by Spark, any
    other is a file of the driver."""
    if "://" in vocabulary:
        data = bytes(spark.read.format("binaryFile").load(vocabulary).select("content").first()[0])
    else:
        data = Path(vocabulary).read_bytes()
    return spark.sparkContext.broadcast(data)


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, chars, tokens: the leaves of every document's tree, to be written as a table."""
    ship_package(docs.sparkSession)
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(_build(shared, pattern), f"id {d.schema['id'].dataType.simpleString()}, {TREE}")


def edit_trees(trees: DataFrame, edits: DataFrame | Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN, trees_too: bool = True) -> DataFrame:
    """id, text, chars, tokens after the edits, unless only counts are asked for, and the counts before
    and after. edits: a column of type EDITS over the columns of trees, or a table (id, edits)."""
    ship_package(trees.sparkSession)
    shared = shared_vocabulary(trees.sparkSession, vocabulary)
    d = trees.join(edits.select("id", "edits"), "id", "left") if isinstance(edits, DataFrame) else trees.withColumn("edits", edits)
    d = d.select("id", "text", "chars", "tokens", F.col("edits").cast(EDITS).alias("edits"))
    kinds = ", ".join(f"{c} bigint" for c in COUNTS)
    return d.mapInArrow(_edit(shared, pattern, trees_too), f"id {d.schema['id'].dataType.simpleString()}, {TREE + ', ' if trees_too else ''}{kinds}")


def count_tokens(docs: DataFrame, edits: Column | None = None, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every document before and after its edits, a column of type EDITS over text. The trees are
    written to the shared folder and the edits applied to what is stored."""
    trees = write_table(build_trees(docs, vocabulary, pattern, id_col, text_col), "trees", compression="zstd")
    todo = edits if edits is not None else F.lit(None)
    return edit_trees(trees, todo, vocabulary, pattern, trees_too=False).withColumnRenamed("id", id_col)


def revision(text: Column) -> Column:
    """A fixed revision of a text: a replacement, an insertion and a deletion at its quarters."""
    n = F.char_length(text)
    e = lambda at, drop, insert: F.struct(at.cast("int").alias("at"), F.lit(drop).alias("drop"), F.lit(insert).alias("insert"))
    return F.when(text.isNotNull(), F.array(e(F.floor(n / 4), 9, " revised it's"), e(F.floor(n / 2), 0, "\n\n Updated in 2024.\n"), e(F.floor(3 * n / 4), 17, "")))
