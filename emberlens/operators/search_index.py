"""Search of log messages by an index of trigrams, kept as tables beside the events.

Events are cut into blocks of BLOCK ids. Postings tell for a trigram and a block which of its events hold it, so
no list is longer than a block, however frequent a trigram. Postings are sorted by trigram and block and events
by id; a search reads only the row groups of its own trigrams and blocks, intersects the lists of each block,
and verifies the events that are left by their text.

Defined results: an event without a message is found by searches without text only; an empty table gives an
empty index, in which nothing is found; of events that repeat an id all are found; ids may be negative;
columns of events are kept whatever their names, but none may begin with two underscores. A text of fewer than
three characters has no trigram: its search reads all events behind ``after``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.operators.logs import search
from emberlens.session import table_path

#: Ids of a block; characters of a message that are cut into trigrams at once.
BLOCK, PIECE = 4_096, 256
#: Blocks with candidates up to which they are named to the scan of events; more are joined.
NAMED_BLOCKS = 2_000


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none of a null or shorter text."""
    low = F.lower(text)
    n = F.char_length(low)
    # pieces overlap by two characters, so that every run lies in one, and none is sought from the start of a long text
    pieces = F.transform(F.sequence(F.lit(0), F.floor((n - 3) / PIECE).cast("int")), lambda k: F.substring(low, k * PIECE + 1, F.lit(PIECE + 2)))
    runs = F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.when(n >= 3, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))


def _block(ident: Column) -> Column:
    return F.floor(ident / BLOCK)


@dataclass(frozen=True)
class SearchIndex:
    """Where an index lies."""

    path: str

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/events")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings")


def build(events: DataFrame, path: str | None = None) -> SearchIndex:
    """Write the index of events (id, message, ...) to a path, or to a new table of the shared folder."""
    path = path or table_path(events.sparkSession, "search-index")
    d = events.withColumn("__block", _block(F.col("id")))
    d.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/events")
    kept = events.sparkSession.read.parquet(f"{path}/events")
    offset = (F.col("id") - F.col("__block") * BLOCK).cast("smallint")
    p = kept.select("__block", offset.alias("at"), F.explode(trigrams(F.col("message"))).alias("gram"))
    p = p.groupBy("gram", "__block").agg(F.sort_array(F.collect_set("at")).alias("at"))
    p.repartitionByRange("gram", "__block").sortWithinPartitions("gram", "__block").write.parquet(f"{path}/postings")
    return SearchIndex(path)


def grams_of(text: str) -> list[str]:
    low = text.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def candidates(index: SearchIndex, spark: SparkSession, text: str, after: int | None = None) -> DataFrame:
    """id of the events behind ``after`` that hold all trigrams of a text of three characters or more."""
    grams = grams_of(text)
    if not grams:
        raise ValueError("a text of fewer than three characters has no trigram")
    p = index.postings(spark).where(F.col("gram").isin(grams))
    if after is not None:
        p = p.where(F.col("__block") >= after // BLOCK)
    lists = p.groupBy("__block").agg(F.collect_list("at").alias("lists")).where(F.size("lists") == len(grams))
    common = F.aggregate("lists", F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
    d = lists.select("__block", F.explode(common).alias("at")).select((F.col("__block") * BLOCK + F.col("at")).alias("id"))
    return d if after is None else d.where(F.col("id") > after)


def indexed_search(index: SearchIndex, spark: SparkSession, text: str, filters: Mapping[str, str] | None = None, since: str | None = None, until: str | None = None, after: int = 0, limit: int = 100) -> DataFrame:
    """The page that ``logs.search`` gives for a text, equal fields and a range of time."""
    e = index.events(spark)
    if grams_of(text):
        found = candidates(index, spark, text, after)
        blocks = found.select(_block(F.col("id")).alias("__block")).distinct()
        some = [r[0] for r in blocks.limit(NAMED_BLOCKS + 1).collect()]
        if len(some) <= NAMED_BLOCKS:
            e = e.where(F.col("__block").isin(some) if some else F.lit(False))
        e = e.join(found, "id", "left_semi")
    return search(e, filters, text, since, until, after, limit).drop("__block")
