"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Every document draws an exponential key, scaled by its quality weight. Within a source documents
are taken in key order until the prefix sum of their sizes reaches the source's budget. A budget
beyond the source's whole size first takes complete epochs; only the rest is a selection. The
draw is a hash of the document id, so reruns agree.

No source is sorted in one task. Keys fall into 2**24 buckets, refined 256 at a time: sums per
bucket find the bucket in which the budget ends, and only the documents of that bucket are
ordered. The document in which the budget ends gives the words that are still missing.

Defined results: null texts have size 0; a null source is a source of its own, last in order; a
null id draws by the text; documents whose id repeats are taken each, in text size order; of very long
texts the words are counted whole, and one may be taken in part; an empty table gives an empty result;
other columns are ignored, whatever their names. Sources are few: one task orders them, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
LEVELS, FAN = 3, 256
EPOCHS = 3
#: Sources up to which their budgets are broadcast, some 100 bytes each; beyond it the join is shuffled.
BROADCAST_SOURCES = 100_000


def words_in(text: Column) -> Column:
    """Number of words: starts of runs that aren't white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform_of(doc_id: Column, text: Column) -> Column:
    """A uniform draw in (0, 1) from the id, or from the text where that is null."""
    h = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))), 1, 13)
    return (F.conv(h, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target. sources: (source, source_size), one row each.

    Weights repeat over the sources in code point order. The shares of the whole size stop at
    ``epochs`` times a source's size; what is over goes to the others by weight until none is
    above. That is the level at which capped sources hold their cap and all others level * weight,
    found by walking the sources in order of cap per weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.get(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(order) - 1) % len(weights))
    s = sources.withColumn("weight", w.cast("bigint")).withColumn("cap", F.col("source_size") * epochs)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    target = F.when(F.col("cap") < F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"), F.col("cap").cast("double")).otherwise(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS, quality_weights: tuple[float, float, float] = (1.0, 2.0, 3.0), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc id, size, source_size, target, taken for every document.

    quality: (doc_id, quality 0/1) of some documents; quality_weights are those of quality 0, of
    unlabelled documents and of quality 1.
    """
    draw = uniform_of(F.col(id_col), F.col(text_col))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), draw.alias("draw"))
    low, mid, high = (float(x) for x in quality_weights)
    if quality is None:
        d = d.withColumn("w", F.lit(mid))
    else:
        q = quality.select(F.col("doc_id"), F.col("quality")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        d = d.join(q, "doc_id", "left").withColumn("w", F.when(F.col("quality") == 1, high).when(F.col("quality") == 0, low).otherwise(mid)).drop("quality")
    d = d.withColumn("key", -F.log("draw") / F.col("w"))
    spread = 1 - F.exp(-F.col("key") * min(quality_weights))
    cell = F.least(F.floor(spread * float(FAN**LEVELS)), F.lit(FAN**LEVELS - 1)).cast("bigint")
    d = cut_lineage(d.select("doc_id", "source", "size", "key", cell.alias("cell")))

    sources = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    sources = sources.withColumn("rounds", F.least(whole, F.lit(epochs).cast("bigint")))
    sources = sources.withColumn("rest", F.greatest(F.floor(F.col("target")).cast("bigint") - F.col("rounds") * F.col("source_size"), F.lit(0)))
    sources = cut_lineage(sources.withColumn("slot", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))))

    # the cell in which each source's budget ends, a digit of the cell number at a time
    slot = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    at = sources.select("slot", "rest", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    keyed = d.select(slot.alias("slot"), "size", "cell")
    for level in range(LEVELS):
        step = FAN ** (LEVELS - 1 - level)
        sums = keyed.groupBy("slot", F.floor(F.col("cell") / step).cast("bigint").alias("digit")).agg(F.sum("size").alias("part"))
        near = sums.join(at, "slot").where(F.floor(F.col("digit") / FAN) == F.col("prefix"))
        run = F.sum("part").over(Window.partitionBy("slot").orderBy("digit"))
        near = near.withColumn("upto", F.col("before") + run)
        last = near.groupBy("slot").agg(
            F.min(F.when(F.col("upto") >= F.col("rest"), F.struct("digit", (F.col("upto") - F.col("part")).alias("before")))).alias("hit"), F.max(F.struct("digit", "upto")).alias("end")
        )
        at = at.join(last, "slot").select("slot", "rest", F.coalesce("hit.digit", F.col("end.digit")).alias("prefix"), F.coalesce("hit.before", F.col("end.upto")).alias("before"))
        at = cut_lineage(at)
    edge = at.select("slot", F.col("prefix").alias("edge"), "before")

    plan = cut_lineage(sources.drop("source").join(edge, "slot"))
    few = plan.count() <= BROADCAST_SOURCES
    each = d.withColumn("slot", slot).join(F.broadcast(plan) if few else plan, "slot")
    outside = each.where(F.col("cell") != F.col("edge")).withColumn("part", F.when(F.col("cell") < F.col("edge"), F.col("size")).otherwise(0))
    in_order = Window.partitionBy("slot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = each.where(F.col("cell") == F.col("edge"))
    ahead = F.col("before") + F.sum("size").over(in_order) - F.col("size")
    inside = inside.withColumn("part", F.greatest(F.least(F.col("rest") - ahead, F.col("size")), F.lit(0)))
    taken = (F.col("rounds") * F.col("size") + F.when(F.col("rest") > 0, F.col("part")).otherwise(0)).cast("bigint")
    return outside.unionByName(inside).select(F.col("doc_id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "source")
