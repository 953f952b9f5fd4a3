"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed into phrases, each
the longest match in the language's training text from where the last phrase ended; with n training
characters and c phrases over N characters the cross entropy is c * log2(n) / N bits a character.
The language that needs fewest normalised phrases wins, ties going to the label seen more often.

Texts are parsed whole. Many blocks of BLOCK characters are parsed at a time, first each as if it
began a phrase; then, from left to right, a block is parsed again from the state in which the block
before it ended, until it meets its first parse, behind which both are the same. So no phrase ends at
a block's border. Every learned letter of any script has a code of its own; the transitions are kept
sparse, in some 16 bytes each. Letters are lower-cased and keep their combining marks; each run of
anything else is one blank.

Learning takes a bounded sample: of each language the texts with the least hash in DOCS_PER_LANG
classes, joined up to CHARS_PER_LANG characters; the driver gets at most some three times that a
language. Only text and label enter. Languages are labels, hundreds at most: each worker holds an
automaton of each, some 3 MB.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for every
text if nothing was learned; very long texts are parsed whole, at some 40 bytes a character; rows
that repeat are answered each; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.session import ship_package

DOCS_PER_LANG, CHARS_PER_LANG = 64, 40_000
BLOCK, BATCH_CHARS = 512, 1_000_000
UND = "und"


@dataclass(frozen=True)
class Training:
    """(language, labelled documents, text) in order of precedence at ties."""

    languages: tuple[tuple[str, int, str], ...]


def kept(c: str) -> bool:
    """Letters and the marks that belong to them."""
    return c.isalpha() or unicodedata.category(c)[0] == "M"


def lowered(c: str) -> str:
    """The first character of the lower case, so that one character stays one."""
    return c.lower()[:1]


def fold(text: str) -> str:
    """Lower-cased letters, each run of other characters one blank, a blank at both ends."""
    return " " + " ".join("".join(lowered(c) if kept(c) else " " for c in text).split()) + " "


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the suffix automaton of text; state 0 is the root."""
    link, length, step, last = [-1], [0], [{}], 0
    for c in text:
        new, p = len(link), last
        link.append(0), length.append(length[last] + 1), step.append({})
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                link.append(link[q]), length.append(length[p] + 1), step.append(dict(step[q]))
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def learn(docs: DataFrame, trainable: Column, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, chars_per_lang: int = CHARS_PER_LANG) -> Training:
    """Training text of every label among the trainable rows; its size is bounded per language."""
    t = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), trainable.alias("ok")).where("ok and text is not null and lang is not null")
    t = t.select("lang", "text", F.xxhash64("text").alias("h"))
    classes = t.groupBy("lang", F.pmod("h", F.lit(docs_per_lang)).alias("c")).agg(F.min("h").alias("h"), F.count("*").alias("n")).collect()
    seen: Counter = Counter()
    for r in classes:
        seen[r.lang] += r.n
    chosen = t.where(F.col("h").isin([r.h for r in classes])).groupBy("lang", "h").agg(F.min(F.substring("text", 1, 2 * chars_per_lang)).alias("text"))
    before = F.sum(F.char_length("text")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    rows = chosen.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < 2 * chars_per_lang).select("lang", "h", "text").collect() if classes else []
    out = []
    for lang, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        parts, have = [], 0
        for r in sorted((r for r in rows if r.lang == lang), key=lambda r: r.h):
            if have < chars_per_lang:
                parts.append(fold(r.text)[:-1])
                have += len(parts[-1])
        text = ("".join(parts) + " ")[:chars_per_lang]
        if text.strip():
            out.append((lang, n, text))
    return Training(tuple(out))


class Transitions:
    """The transitions of a suffix automaton in one array, rows laid over each other.

    A state is known by its place; the transition by letter code c is at place + c. There its upper
    half names the place it belongs to, its lower half the next state's place.
    """

    def __init__(self, states: list[dict[str, int]], code: dict[str, int], width: int):
        rows = [(sorted((code[c], to) for c, to in out.items())) for out in states]
        self._room = np.zeros(2 * sum(map(len, rows)) + 4 * width + 64, dtype=bool)  # slots taken
        self._named = np.zeros(len(self._room), dtype=bool)  # places taken
        place = np.full(len(rows), -1, dtype=np.int64)
        many = sorted((i for i, r in enumerate(rows) if len(r) > 1), key=lambda i: (-len(rows[i]), i))
        low, before = 0, 0
        for i in many:
            codes = np.array([c for c, _ in rows[i]])
            low = low if len(codes) == before else 0
            place[i] = low = self._fit(codes, low)
            before = len(codes)
        single = np.array([i for i, r in enumerate(rows) if len(r) == 1], dtype=np.int64)
        codes = np.array([rows[i][0][0] for i in single], dtype=np.int64)
        for turn in range(12):  # each single transition gets a free slot of its own, if its place is free as well
            if not len(single):
                break
            free = np.flatnonzero(~self._room)
            free = np.roll(free[free >= width], -turn)[: len(single)]
            n = len(free)
            at = free - codes[:n]
            first = np.zeros(n, dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            good = first & ~self._named[at]
            place[single[:n][good]] = at[good]
            self._room[free[good]] = self._named[at[good]] = True
            left = np.append(~good, np.ones(len(single) - n, dtype=bool))
            single, codes = single[left], codes[left]
        low = 0
        for i, c in zip(single, codes, strict=True):
            place[i] = low = self._fit(np.array([c]), low)
        for i, r in enumerate(rows):
            if not r:
                place[i] = self._fit(np.empty(0, dtype=np.int64), 0)
        self.nowhere = int(np.flatnonzero(~self._named)[0])  # the state behind a letter that the text lacks
        self._named[self.nowhere] = True
        self.root = int(place[0])
        self.edges = np.full(int(place.max(initial=0)) + width + 1, -1, dtype=np.int64)
        for i, r in enumerate(rows):
            for c, to in r:
                self.edges[place[i] + c] = place[i] << 32 | place[to]
        self.begin = np.full(width, self.nowhere, dtype=np.int64)
        for c, to in rows[0]:
            self.begin[c] = place[to]
        if self.nowhere + width > len(self.edges):
            self.edges = np.append(self.edges, np.full(self.nowhere + width - len(self.edges), -1))
        del self._room, self._named

    def _fit(self, codes: np.ndarray, low: int) -> int:
        """The first place from low on that is free and whose slots are."""
        reach = int(codes[-1]) if len(codes) else 0
        while True:
            n = min(2048, len(self._room) - reach - low)
            if n <= 0:
                more = np.zeros(len(self._room), dtype=bool)
                self._room, self._named = np.append(self._room, more), np.append(self._named, more)
                continue
            fits = ~self._named[low : low + n]
            for c in codes:
                fits = fits & ~self._room[low + c : low + c + n]
            at = int(fits.argmax())
            if fits[at]:
                self._named[low + at] = True
                self._room[low + at + codes] = True
                return low + at
            low += n

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins with the character). The root is left at once."""
        edge = self.edges.take(state + code)
        fresh = (edge >> 32) != state
        to = np.where(fresh, self.begin.take(code), edge & 0xFFFFFFFF)
        return to, fresh


class CrossParser:
    """Automata of all languages over one alphabet. Code 0 is the blank, 1 a letter never learned."""

    def __init__(self, training: Training):
        known = sorted({c for _, _, t in training.languages for c in t if c != " "})
        code = {" ": 0} | {c: i + 2 for i, c in enumerate(known)}
        self.codes, self.letter = np.zeros(0x110000, dtype=np.int32), np.zeros(0x110000, dtype=bool)
        # planes 4 to 13 have no letters, nor has what follows the marks of plane 14
        for cp in [*range(0x40000), *range(0xE0000, 0xE1000)]:
            if kept(c := chr(cp)):
                self.codes[cp] = code.get(lowered(c), 1)
                self.letter[cp] = c.isalpha()
        self.langs = [lang for lang, _, _ in training.languages]
        self.bits = [math.log2(max(2, len(t))) for _, _, t in training.languages]
        self.automata = [Transitions(suffix_automaton(t), code, len(code) + 1) for _, _, t in training.languages]

    @staticmethod
    def phrases(automaton: Transitions, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, follows: np.ndarray, lane: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
        """Phrases that begin inside each block behind its first character. Blocks come in order of their
        texts; follows tells those that go on with the text of the block before. Lanes are the blocks in
        order of their size, steps the codes of each lane at each of its characters."""
        state, fresh_n = np.full(len(begin), automaton.root), np.zeros(len(begin), dtype=np.int64)
        states, marks = [], []
        for t, code in enumerate(steps):
            n = len(code)
            to, fresh = automaton.step(state[:n], code)
            if t == 0:
                fresh[:] = False
            state[:n] = to
            fresh_n[:n] += fresh
            states.append(to), marks.append(fresh)
        ended, count = state[lane], fresh_n[lane]  # in the order of the blocks
        entered = np.full(len(begin), automaton.root)
        while True:
            came = np.where(follows, np.roll(ended, 1), automaton.root)
            todo = np.flatnonzero(came != entered)
            if not len(todo):
                return count
            entered[todo] = came[todo]
            now, where = came[todo], np.arange(len(todo))
            for t in range(BLOCK):
                in_text = t < size[todo[where]]
                if not in_text.all():  # parsed to its end without meeting the first parse
                    over = where[~in_text]
                    ended[todo[over]] = now[over]
                    where = where[in_text]
                if not len(where):
                    break
                at, now_at = todo[where], lane[todo[where]]
                to, fresh = automaton.step(now[where], codes[begin[at] + t])
                met = to == states[t][now_at]
                count[at] += fresh.astype(np.int64) - marks[t][now_at]
                states[t][now_at], marks[t][now_at], now[where] = to, fresh, to
                where = where[~met]
            ended[todo[where]] = now[where]

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language (-1: none) and score of each text."""
        points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.codes[points]
        ends = np.cumsum([1] + [len(t) + 1 for t in texts])
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        place = np.cumsum(keep)  # folded characters up to and with each
        codes, lettered = codes[keep], np.concatenate([[0], np.cumsum(self.letter[points[keep]])])
        first, stop = place[ends[:-1] - 1] - 1, place[ends[1:] - 1]  # with the blanks around
        letters = lettered[stop] - lettered[first]
        n_blocks = np.where(letters > 0, -(-(stop - first) // BLOCK), 0)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        begin = first[owner] + BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
        size = np.minimum(BLOCK, stop[owner] - begin)
        follows = np.append(False, owner[1:] == owner[:-1])[: len(owner)]
        order = np.argsort(-size, kind="stable")
        start, sizes, lane = begin[order], size[order], np.empty(len(order), dtype=np.int64)
        lane[order] = np.arange(len(order))
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(BLOCK), side="right")
        steps = [codes[start[:n] + t] for t, n in enumerate(active) if n]
        cost = np.zeros((len(self.langs), len(texts)))
        for k, automaton in enumerate(self.automata):
            cost[k] = (np.bincount(owner, self.phrases(automaton, codes, begin, size, follows, lane, steps), len(texts)) + 1) * self.bits[k]
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts))
        best = cost.argmin(0)
        low = cost.min(0)
        next_low = np.partition(cost, 1, axis=0)[1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(letters > 0, 1 - low / next_low, 0.0)
        return np.where(letters > 0, best, -1), np.clip(np.nan_to_num(score), 0.0, 1.0)


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of some BATCH_CHARS bytes each, or of one text; null texts are empty."""
    sizes = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
    i = 0
    while i < len(texts):
        done = int(sizes[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(sizes, done + BATCH_CHARS, side="right")))
        yield [t or "" for t in texts.slice(i, j - i).to_pylist()]
        i = j


def predict_batches(parser, keep_text: bool = False):
    """For mapInArrow, with a broadcast CrossParser: lang_pred and score are added to a batch, and its column ``text`` goes unless kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = parser.value
        names = pa.array([*held.langs, UND])
        for b in batches:
            best, score = [np.empty(0, int)], [np.empty(0)]
            for chunk in _chunks(b.column("text")):
                i, s = held.parse(chunk)
                best.append(i), score.append(s)
            i, s = np.concatenate(best), np.concatenate(score)
            rest = [n for n in b.schema.names if keep_text or n != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in rest], names.take(pa.array(np.where(i < 0, len(held.langs), i))), pa.array(s)], [*rest, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, training: Training, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns, lang_pred, score of every row. The automata are built once and broadcast."""
    out, named = _identified(docs, training, text_col, carry)
    return out.select(*[F.col(n).alias(c) for c, n in named.items()], "lang_pred", "score")


def _identified(docs: DataFrame, training: Training, text_col: str, carry: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """Carried columns under names of our own (second: by their names), lang_pred and score."""
    spark = docs.sparkSession
    ship_package(spark)
    names = [f"c{i}" for i in range(len(carry))]
    named = {c: "text" if c == text_col else n for c, n in zip(carry, names, strict=True)}
    d = docs.select(*[F.col(c).alias(n) for c, n in named.items()], *([] if text_col in carry else [F.col(text_col).alias("text")]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if text_col in carry or f.name != "text")
    parser = spark.sparkContext.broadcast(CrossParser(training))
    return d.mapInArrow(predict_batches(parser, text_col in carry), f"{kinds}, lang_pred string, score double"), named


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from; a null id is in neither fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the documents that aren't held out."""
    training = learn(docs, learnable(F.col("doc_id")))
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(d, training, carry=("doc_id", "held_out"))


def keep_identified(docs: DataFrame, languages: tuple[str, ...] | None = None, lang_col: str = "lang") -> DataFrame:
    """The documents in which a language is found, or one of those wanted, with all their columns; where
    ``lang_col`` is null it becomes the language found. Those without a letter go."""
    training = learn(docs, learnable(F.col("doc_id")))
    out, named = _identified(docs, training, "text", tuple(docs.columns))
    out = out.where(F.col("lang_pred") != UND) if languages is None else out.where(F.col("lang_pred").isin(*languages))
    return out.select(*[(F.coalesce(F.col(n), F.col("lang_pred")) if c == lang_col else F.col(n)).alias(c) for c, n in named.items()])
