"""Phrase collocation mining by level-wise Apriori passes over a corpus.

Pass k counts phrases of k words, but only those both of whose overlapping phrases of k - 1 words are
frequent; the frequent ones of the passes before are broadcast for that. Frequent phrases of each pass go to
a table of the shared folder. A candidate's cuts are then scored from these level tables, candidates that a
longer one mostly covers are dropped, and the rest is ranked by ranges, so that no language is ranked in one
task.

Up to EXACT_WORDS frequent words and EXACT_PHRASES phrases a level, what is broadcast are the words and for
each level the sorted codes of its phrases: the place of its first words among those of the level before, and
the number of its last word. Tasks then count codes, 64-bit numbers that stand for one phrase each, and
only frequent ones are spelt out again. Beyond either bound a pass counts the phrases themselves and is
helped by a Bloom filter of FILTER_BITS bits (16 MB) that Spark makes. A phrase is frequent only if its parts
are, so one that the filter lets through by mistake is counted and then isn't frequent: results are the same.
Numbers are exact: scores are computed in decimals of 38 digits, enough up to counts of 10**15.

Defined results: a null language is ``und``, one with a text that says ``und``; a null text is empty; texts
without words, or with separators alone, only give no phrases; words and texts of any length are read
whole, long texts in blocks; documents that repeat count each; ties of score and count are ranked by the
bytes of the phrase; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.llm.lookup import look_up
from emberlens.operators.quantiles import numbered
from emberlens.session import ship_package, write_table

LEAST, LONGEST, TOP, COVER_PERCENT = 10, 3, 2_000, 50
NO_LANGUAGE = "und"
#: Words that are counted together, and bytes of a text that are split at a time.
BLOCK_WORDS, BLOCK_BYTES = 1_000_000, 2_000_000
EXACT_WORDS, WORD_BYTES, EXACT_PHRASES, FILTER_BITS = 1 << 20, 64 << 20, 1 << 22, 1 << 27

BREAKS = b".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]+|[.,;:!?\n\x0b\x0c\r]+")
BETWEEN = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
STOP = b"."


def _hash(lang: str, phrases: list[bytes]) -> np.ndarray:
    """As Spark's xxhash64(lang, phrase)."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in phrases), np.uint64, len(phrases))


class Levels:
    """The frequent words, in order of their hashes, and the sorted codes of the frequent phrases of two words, of
    three, and so on."""

    def __init__(self, words: pa.Table):
        """words: (h, lang, phrase)."""
        h = words["h"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        self.langs = words["lang"].combine_chunks().dictionary_encode().take(pa.array(order))
        self.words = words["phrase"].combine_chunks().cast(pa.binary()).take(pa.array(order))
        self.codes: list[np.ndarray] = []

    def clear(self) -> bool:
        """Whether hashes tell all words apart."""
        return len(np.unique(self.hashes)) == len(self.hashes)

    def numbers(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The numbers of words, -1 for those that aren't frequent."""
        if not len(self.hashes) or not words:
            return np.full(len(words), -1)
        h = _hash(lang, words)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = (self.hashes[at] == h) & pc.equal(self.words.take(pa.array(at)), pa.array(words, pa.binary())).to_numpy(zero_copy_only=False)
        same &= pc.equal(self.langs.dictionary.take(self.langs.indices.take(pa.array(at))), lang).to_numpy(zero_copy_only=False)
        return np.where(same, at, -1)

    def count(self, tokens: list[bytes], size: int, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the phrases of ``size`` words whose parts are frequent, with their counts."""
        names = [t for t in dict.fromkeys(tokens) if t[0] not in BREAKS]
        place = dict(zip(names, self.numbers(lang, names).tolist()))
        word = np.fromiter((place.get(t, -1) for t in tokens), np.int64, len(tokens))
        gram = word
        for k in range(2, size + 1):
            both = (gram[:-1] >= 0) & (gram[1:] >= 0)
            code = (gram[:-1][both] << 32) | word[k - 1 :][both]
            if k == size:
                return np.unique(code, return_counts=True)
            known = self.codes[k - 2]
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            gram = np.full(len(both), -1)
            gram[both] = np.where(known[at] == code, at, -1) if len(known) else -1

    def spell(self, codes: np.ndarray, size: int) -> tuple[pa.Array, pa.Array]:
        """Languages and phrases."""
        parts, code = [], codes
        for k in range(size, 1, -1):
            parts.append(code & 0xFFFFFFFF)
            code = code >> 32
            if k > 2:
                code = self.codes[k - 3][code]
        words = [self.words.take(pa.array(x)).cast(pa.large_binary()) for x in (code, *reversed(parts))]
        return self.langs.dictionary.take(self.langs.indices.take(pa.array(code))), pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string())


class PhraseFilter:
    """Which phrases of the last pass are frequent; may also say so of some that aren't."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, lang: str, phrases: list[bytes]) -> np.ndarray:
        h, found = _hash(lang, phrases), np.ones(len(phrases), bool)
        for shift in (0, 32):
            bit = (h >> np.uint64(shift)) & np.uint64(FILTER_BITS - 1)
            found &= (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return found


def filter_of(level: DataFrame) -> PhraseFilter:
    """level: (lang, phrase). The driver gets the words of FILTER_BITS bits that aren't zero."""
    h = level.select(F.xxhash64("lang", "phrase").alias("h"))
    bits = h.select(F.explode(F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(FILTER_BITS - 1)) for s in (0, 32)])).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS INT))")).alias("w")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["at"].to_numpy()] = words["w"].to_numpy().astype(np.int64).view(np.uint64)
    return PhraseFilter(out)


def count_block(tokens: list[bytes], size: int, lang: str, known: PhraseFilter | None) -> tuple[list[bytes], np.ndarray]:
    """Phrases of ``size`` words of a run of tokens, with their counts; the empty phrase counts words (size 1)."""
    names = [t for t in dict.fromkeys(tokens) if t[0] not in BREAKS]
    place = {t: i for i, t in enumerate(names)}
    code = np.fromiter((place.get(t, -1) for t in tokens), np.int64, len(tokens))
    gram, v = code, max(1, len(names))
    if size == 1:
        counts = np.bincount(code[code >= 0], minlength=len(names))
        return [*names, b""], np.append(counts, counts.sum())
    words = names
    for k in range(2, size + 1):
        if k == size and known is not None:
            gram = np.where(np.append(known.holds(lang, names), False)[gram], gram, -1)
        both = (gram[:-1] >= 0) & (gram[1:] >= 0)
        pair = gram[:-1][both] * v + code[k - 1 :][both]
        which, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        names = [names[a] + b" " + words[b] for a, b in zip((which // v).tolist(), (which % v).tolist())]
        gram = np.full(len(both), -1)
        gram[both] = inverse
    return names, counts


ROWS = 100_000


def _blocks(size: int, emit):
    """Runs of tokens of one language, each counted by emit(lang, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        n = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary())):
                data, at = (text.as_py() or b"").lower(), 0
                while at < len(data):
                    end = at + BLOCK_BYTES
                    cut = BETWEEN.search(data, end) if end < len(data) else None
                    end = cut.start() if cut else len(data)
                    tokens = TOKEN.findall(data, at, end)
                    mine = held.setdefault(lang, [])
                    mine += tokens
                    n, at = n + len(tokens), end
                    if n >= BLOCK_WORDS:
                        # the text may go on: its last words begin the next block, too few to be counted again
                        rest = mine[max(0, len(mine) - size + 1) :] if size > 1 else []
                        for k, t in held.items():
                            yield from emit(k, t)
                        held, n = {lang: rest}, 0
                if data:
                    held.setdefault(lang, []).append(STOP)
        for k, t in held.items():
            yield from emit(k, t)

    return run


def _spelt(size: int, known):
    """Rows (lang, phrase, n)."""

    def emit(lang: str, tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
        phrases, counts = count_block(tokens, size, lang, known.value if known else None)
        for i in range(0, len(phrases), ROWS):
            part = phrases[i : i + ROWS]
            kind = pa.string() if sum(map(len, part)) < 1 << 30 else pa.large_string()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(kind), pa.array(counts[i : i + ROWS], pa.int64())], ["lang", "phrase", "n"])

    return _blocks(size, emit)


def _coded(size: int, levels):
    """Rows (code, n)."""

    def emit(lang: str, tokens: list[bytes]) -> Iterator[pa.RecordBatch]:
        codes, counts = levels.value.count(tokens, size, lang)
        for i in range(0, len(codes), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + ROWS]), pa.array(counts[i : i + ROWS], pa.int64())], ["code", "n"])

    return _blocks(size, emit)


def _spell(size: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, phrase = levels.value.spell(b.column("code").to_numpy(), size)
            yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.string()), b.column("n"), b.column("code")], ["lang", "phrase", "n", "code"])

    return run


def count_levels(texts: DataFrame, least: int, longest: int, exact: tuple[int, int]) -> list[DataFrame]:
    """(lang, phrase, n) of the frequent phrases of one word (with the count of all words as the empty phrase), of two, and so on. texts: (lang, text)."""
    sc = texts.sparkSession.sparkContext
    words = texts.mapInArrow(_spelt(1, None), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    out = [write_table(words.where((F.col("n") >= least) | (F.col("phrase") == "")), "phrases-1")]
    known = out[0].where("phrase <> ''")
    levels = None
    held = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0)).alias("size")).first()
    if held.n <= exact[0] and held.size <= WORD_BYTES:
        levels = Levels(known.select(F.xxhash64("lang", "phrase").alias("h"), "lang", "phrase").toArrow())
        levels = levels if levels.clear() else None
    for k in range(2, longest + 1):
        if levels is not None:
            held = sc.broadcast(levels)
            counted = texts.mapInArrow(_coded(k, held), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            table = write_table(counted.mapInArrow(_spell(k, held), "lang string, phrase string, n bigint, code bigint"), f"phrases-{k}")
            out.append(table.drop("code"))
            if k < longest and table.count() <= exact[1]:
                levels.codes.append(np.sort(table.select("code").toArrow()["code"].to_numpy()))
            else:
                levels = None
        else:
            held = sc.broadcast(filter_of(out[-1].where("phrase <> ''")))
            counted = texts.mapInArrow(_spelt(k, held), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
            out.append(write_table(counted.where(F.col("n") >= least), f"phrases-{k}"))
    return out


def mine_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover_percent: int = COVER_PERCENT, text_col: str = "text", lang_col: str = "lang", exact: tuple[int, int] = (EXACT_WORDS, EXACT_PHRASES)) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    levels = count_levels(texts, least, longest, exact)
    words = levels[0].where("phrase = ''").select("lang", "n")
    levels[0] = levels[0].where("phrase <> ''")
    sized = [d.withColumn("size", F.lit(k)) for k, d in enumerate(levels, 1)]
    every = sized[0]
    for d in sized[1:]:
        every = every.unionByName(d)
    candidates = every.where("size >= 2").withColumnRenamed("n", "a")

    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumn("head", F.expr("substring_index(phrase, ' ', cut)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    for part, out in (("head", "l"), ("rest", "r")):
        cuts = look_up(cuts, every.select("lang", F.col("phrase").alias(part), F.col("n").alias(out)), ["lang", part])
        cuts = write_table(cuts, "cuts")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("upper", (F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")).cast("decimal(31,0)")).cast("decimal(38,0)")).withColumn("lower", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("upper div lower"))
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c")).select("lang", "phrase", "size", "a", "c.l", "c.r", "c.score")

    inner = candidates.where("size >= 3").withColumn("w", F.split("phrase", " "))
    inner = inner.withColumn("part", F.explode(F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(w, i, k), ' '))))")))
    longer = inner.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover_percent))

    placed = numbered(kept.drop("size", "longer"), ["lang", F.desc("score"), F.desc("a"), "phrase"], "place")
    first = placed.groupBy("lang").agg(F.min("place").alias("first")).join(words, "lang")
    ranked = look_up(placed, first, ["lang"]).withColumn("rank", (F.col("place") - F.col("first") + 1).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
