"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are short and documents long, so containment of the item in the document is what
counts, not their similarity. Items with one set of shingles are one set. Sets are partitioned by
number of shingles into powers of two. Each partition has its own length of MinHash sketch, the k
smallest hashes of a set's shingles, with k the least number for which an item contained to the
threshold must share one of them: of n shingles at most n - ceil(t * n) may be absent, so
n - ceil(t * n) + 1 sketch hashes miss no item, and the partition takes that number at its upper size.

Sketches are broadcast while their rows stay within a limit, partitions of short items first, whose hashes
reach furthest; those meet all shingle hashes of the documents in one map-side join. The rest is probed
through a shuffle by hash, of which the largest sketch hash of the remaining partitions keeps out the most.
Documents that meet a set are cut to shingles once for a block of sets, and the shingles of
each, as strings, are counted in the document.

Words are runs of letters, marks and digits of the lower-cased text; a shingle is five words.

Defined results: documents with null id or text, and items with null id or fewer than five words,
take part in no pair; very long texts are searched whole, in memory in proportion to one text;
repeated rows give one pair; of rows that share an id the best counts; empty tables give an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.session import cut_lineage

WIDTH, THRESHOLD = 5, 0.8
WORD = r"[\p{L}\p{M}\p{N}]+"
#: Sketch or item rows up to which they are broadcast, some 100 bytes each; beyond it they are shuffled.
BROADCAST_ROWS = 100_000
#: Sets that a document is held against at once.
BLOCK = 64


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingle_text(words: Column, at: Column, width: int) -> Column:
    return F.array_join(F.slice(words, at + 1, width), " ")


def shingle_hash(words: Column, at: Column | int, width: int) -> Column:
    return F.xxhash64(*[F.get(words, F.lit(at) + i if isinstance(at, int) else at + i) for i in range(width)])


def starts(words: Column, width: int) -> Column:
    """Positions of shingles, none where there are too few words."""
    n = F.size(words) - width
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def distinct_shingles(words: Column, width: int) -> Column:
    return F.array_distinct(F.transform(starts(words, width), lambda i: shingle_text(words, i, width)))


def sketch_items(items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(set, item_id; set, shingles, n; set, size class, h: the sketches). items: (item_id, text)."""
    d = items.where("item_id is not null and text is not null").groupBy("item_id", "text").count().select("item_id", words_of(F.col("text")).alias("words"))
    d = d.where(F.size("words") >= width).select("item_id", F.array_sort(distinct_shingles(F.col("words"), width)).alias("shingles"))
    d = cut_lineage(d.withColumn("set", F.sha2(F.array_join("shingles", "\n"), 256)))
    full = cut_lineage(d.groupBy("set").agg(F.first("shingles").alias("shingles")).withColumn("n", F.size("shingles")))
    level = F.floor(F.log2("n")).cast("int")
    upper = F.pow(2.0, level + 1) - 1
    k = (upper - F.ceil(upper * F.lit(threshold)) + 1).cast("int")
    hashes = F.array_distinct(F.transform("shingles", lambda x: shingle_hash(F.split(x, " "), 0, width)))
    sketch = full.select("set", level.alias("level"), F.explode(F.slice(F.array_sort(hashes), 1, F.least(k, F.size(hashes)))).alias("h"))
    return d.select("set", "item_id"), full, cut_lineage(sketch)


def probe(docs: DataFrame, sketch: DataFrame, width: int, broadcast_rows: int) -> DataFrame:
    """doc_id, set of all pairs that share a sketch hash. docs: (doc_id, text)."""
    levels = sketch.groupBy("level").agg(F.count("*").alias("rows"), F.max("h").alias("top")).orderBy("level").collect()  # a row for each power of two
    words = docs.select("doc_id", words_of(F.col("text")).alias("words")).where(F.size("words") >= width)
    at = words.select("doc_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - width)).alias("i"))
    probes = at.select("doc_id", shingle_hash(F.col("words"), F.col("i"), width).alias("h"))
    near, room = [], broadcast_rows
    for r in levels:
        if r.rows > room:
            break
        near.append(r.level)
        room -= r.rows
    far = [r for r in levels if r.level not in near]
    parts = []
    if near or not far:
        parts.append(probes.join(F.broadcast(sketch.where(F.col("level").isin(near)).select("h", "set")), "h"))
    if far:
        parts.append(probes.where(F.col("h") <= max(r.top for r in far)).join(sketch.where(~F.col("level").isin(near)).select("h", "set"), "h"))
    met = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return cut_lineage(met.select("doc_id", "set").distinct())


def find_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of every pair at or above threshold."""
    members, full, sketch = sketch_items(items.select("item_id", "text"), width, threshold)
    small = lambda t: F.broadcast(t) if t.count() <= broadcast_rows else t
    d = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    met = probe(d, sketch, width, broadcast_rows)
    # a document's sets in blocks, so that none has a list without bound
    many = cut_lineage(met.groupBy("doc_id").agg(F.floor(F.count("*") / BLOCK).alias("last")).where("last > 0"))
    block = F.pmod(F.xxhash64("set"), F.coalesce("last", F.lit(0)) + 1)
    blocks = cut_lineage(met.join(small(many), "doc_id", "left").groupBy("doc_id", block.alias("block")).agg(F.collect_list("set").alias("sets")).drop("block"))
    # the generators keep words and shingles columns, which lambda functions would compute for every element anew
    texts = d.join(small(blocks), "doc_id").select("doc_id", "sets", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    texts = texts.select("doc_id", "sets", F.explode(F.array(distinct_shingles(F.col("words"), width))).alias("own"))
    pairs = texts.select("doc_id", "own", F.explode("sets").alias("set")).join(small(full), "set")
    pairs = pairs.select("doc_id", "set", F.col("n").cast("bigint").alias("n_item_shingles"), F.size(F.array_intersect("shingles", "own")).cast("bigint").alias("n_shared"))
    # as integers, so that both sides of the threshold are exact
    pairs = pairs.where(F.col("n_shared") * 1000 >= F.col("n_item_shingles") * round(threshold * 1000))
    worth = F.struct((F.col("n_shared") / F.col("n_item_shingles")).alias("containment"), "n_item_shingles", "n_shared")
    best = pairs.join(small(members), "set").groupBy("doc_id", "item_id").agg(F.max(worth).alias("m"))
    return best.select("doc_id", "item_id", "m.n_item_shingles", "m.n_shared", "m.containment")


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """The documents without any leak, with all their columns; null ids and texts stay."""
    leaky = cut_lineage(find_leaks(docs, items, broadcast_rows=broadcast_rows, **how).select("doc_id").distinct())
    return docs.join(F.broadcast(leaky) if leaky.count() <= broadcast_rows else leaky, "doc_id", "left_anti").select(docs.columns)
