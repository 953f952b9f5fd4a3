"""Corpus profile of log records: bounds, gaps, entry and terminal candidates, levels, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.functions.text import bucket

# fixed values: upper bounds of gaps in seconds with their labels, and the gap thresholds
GAPS = ((0.1, "<100ms"), (1.0, "<1s"), (5.0, "<5s"), (30.0, "<30s"), (300.0, "<300s"))
THRESHOLDS = (1.0, 5.0, 30.0)
PACKAGES = (
    ("org.springframework", "spring"), ("org.hibernate", "hibernate"), ("org.apache.catalina", "tomcat"), ("org.apache.coyote", "tomcat"), ("com.zaxxer.hikari", "hikari"), ("org.apache", "apache"), ("java.", "jdk"), ("javax.", "jdk"), ("jakarta.", "jakarta"), ("io.netty", "netty"), ("reactor.", "reactor"), ("ch.qos.logback", "logback"), ("org.slf4j", "slf4j"),
)


def bounds(records: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    return records.groupBy(*by).agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("records"))


def with_gaps(records: DataFrame) -> DataFrame:
    """records with the last known time and the last site of their thread, and the gap in seconds."""
    in_thread = Window.partitionBy("thread_id").orderBy("o1", "o2")
    before = in_thread.rowsBetween(Window.unboundedPreceding, -1)
    d = records.withColumns({"prev_ms": F.last("ts_ms", ignorenulls=True).over(before), "prev_site": F.lag("call_site").over(in_thread)})
    return d.withColumn("gap_s", F.greatest(F.col("ts_ms") - F.col("prev_ms"), F.lit(0)) / 1000)


def gap_histogram(records: DataFrame) -> DataFrame:
    label = F.lit("longer")
    for bound, name in reversed(GAPS):
        label = F.when(F.col("gap_s") < bound, name).otherwise(label)
    return with_gaps(records).where("gap_s is not null").groupBy(label.alias("gap")).agg(F.count("*").alias("n"))


def entry_terminal(records: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Per threshold and call site: first (after a gap or first of its thread), mid, last (before a gap
    or last of its thread)."""
    d = with_gaps(records).withColumn("is_last", F.lead("o1").over(Window.partitionBy("thread_id").orderBy("o1", "o2")).isNull())
    d = d.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    opens = F.col("gap_s").isNull() | (F.col("gap_s") > F.col("threshold"))
    marks = F.array(
        F.struct(F.col("call_site").alias("site"), opens.cast("int").alias("first"), (~opens).cast("int").alias("mid"), F.col("is_last").cast("int").alias("last")),
        F.struct(F.col("prev_site").alias("site"), F.lit(0).alias("first"), F.lit(0).alias("mid"), F.coalesce(F.col("gap_s") > F.col("threshold"), F.lit(False)).cast("int").alias("last")),
    )
    m = d.select("threshold", F.inline(marks)).where("site is not null")
    return m.groupBy("threshold", F.col("site").alias("call_site")).agg(*[F.sum(c).alias(c) for c in ("first", "mid", "last")]).where("first + mid + last > 0")


def candidates(marks: DataFrame, top: int = 30) -> DataFrame:
    """Best entry and terminal candidates per threshold with their ratio."""
    occ = F.col("first") + F.col("mid")
    d = marks.where(occ > 0)
    d = d.select("threshold", "call_site", F.explode(F.array(F.struct(F.lit("entry").alias("kind"), F.col("first").alias("n"), (F.col("first") / occ).alias("ratio")), F.struct(F.lit("terminal").alias("kind"), F.col("last").alias("n"), (F.col("last") / occ).alias("ratio")))).alias("c"))
    d = d.select("threshold", "call_site", "c.*")
    w = Window.partitionBy("threshold", "kind").orderBy(F.desc("ratio"), F.desc("n"), "call_site")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def entry_verdict(marks: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Whether few call sites with a high entry ratio account for most openings."""
    occ = F.col("first") + F.col("mid")
    d = marks.where((F.col("threshold") == threshold) & (occ >= 5)).withColumn("strong", F.col("first") / occ >= 0.8)
    d = d.agg(F.count_if("strong").alias("strong_sites"), F.coalesce(F.try_divide(100.0 * F.sum(F.when(F.col("strong"), F.col("first")).otherwise(0)), F.sum("first")), F.lit(0.0)).alias("share_pct"))
    return d.withColumn("entry_markers", (F.col("share_pct") >= 70) & (F.col("strong_sites") <= 30))


def levels_by_hour(records: DataFrame, levels: Sequence[str]) -> DataFrame:
    hour = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH")
    return records.where("ts_ms is not null").groupBy(hour.alias("hour")).pivot("level", list(levels)).count().na.fill(0)


def call_sites(records: DataFrame, top: int) -> DataFrame:
    return records.groupBy("call_site").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "call_site").limit(top)


def package_prefix(name: Column) -> Column:
    """A known vendor, else the first three segments."""
    c = F.when(F.size(F.split(name, r"\.")) >= 3, F.substring_index(name, ".", 3)).otherwise(name)
    for prefix, label in reversed(PACKAGES):
        c = F.when(name.startswith(prefix), label).otherwise(c)
    return F.when(name.contains("."), c).otherwise(F.concat(F.lit("(simple) "), F.substring_index(name, "$", 1)))


def cross_file_duplicates(records: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: records of a key seen first in another file, and keys so repeated. Keys are unbounded
    groups only of equal records, so a plain aggregate finds the first file and counts the others."""
    g = records.where("ts_ms is not null").groupBy(*key, "file").agg(F.count("*").alias("n"), F.min(F.struct("o1", "o2")).alias("at"))
    first = g.groupBy(*key).agg(F.min_by("file", "at").alias("f"), F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("file", "n"))).alias("by"))
    extra = F.col("all") - F.element_at("by", F.col("f"))
    return first.select(extra.alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("duplicates"), F.count_if(F.col("x") > 0).alias("keys"))


def boundary(records: DataFrame, margin_ms: int = 60_000) -> DataFrame:
    """One row: threads active within the margin of either end of the corpus."""
    t = records.where("ts_ms is not null").groupBy("thread_id").agg(F.min("ts_ms").alias("a"), F.max_by("ts_ms", F.struct("o1", "o2")).alias("b"), F.max("ts_ms").alias("c"))
    ends = t.agg(F.min("a").alias("low"), F.max("c").alias("high"))
    d = t.crossJoin(F.broadcast(ends))  # one row
    return d.agg(F.count_if(F.col("a") <= F.col("low") + margin_ms).alias("head_threads"), F.count_if(F.col("b") >= F.col("high") - margin_ms).alias("tail_threads"))


def count_bucket(n: Column) -> Column:
    return bucket(n, (1, 10, 100, 1000, 10_000))
