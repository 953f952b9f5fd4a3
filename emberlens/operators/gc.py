"""Garbage-collection analytics over lines (seq_key..., line) or events.

Logs are ordered: a log is one group, its lines carry a number. Numbers of events, the time since the first
stamp and the allocation between collections are running values, for which a large log is cut into ranges;
everything else is an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.functions.text import GC_SIZES, gc_fields
from emberlens.operators.ranges import WINDOW_ROWS, first, last, percentiles, running, total

# fixed values: texts that tell collectors apart, in order
COLLECTORS = (("ZGC", "ZGC"), ("Shenandoah", "Shenandoah"), ("G1 Evacuation", "G1"), ("Pause Young (Normal)", "G1"), ("Pause Remark", "G1"), ("PSYoungGen", "Parallel"), ("ParOldGen", "Parallel"), ("Parallel", "Parallel"), ("ParNew", "CMS"), ("CMS", "CMS"), ("DefNew", "Serial"), ("Tenured", "Serial"))
UPTIME, LEGACY, ISO = r"\[(\d+(?:\.\d+)?)s\]", r"^(?:[\d\-T:.+]+:\s*)?(\d+(?:\.\d+)?):\s", r"\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?[^\]]*)\]"
SAMPLE = 200


# fixed values: words that tell phases apart, the last that fits
PHASES = (("cleanup", "concurrent"), ("mark", "concurrent"), ("remark", "concurrent"), ("concurrent", "concurrent"), ("allocation stall", "stall"), ("young", "young"), ("mixed", "mixed"), ("full", "full"))


def phase_of(head: Column) -> Column:
    low, c = F.lower(head), F.lit("other")
    for word, phase in PHASES:
        c = F.when(low.contains(word), phase).otherwise(c)
    return c


def events(lines: DataFrame, limit: int = WINDOW_ROWS) -> DataFrame:
    """log, seq, ts_s, gc_id, phase, cause, before_mb, after_mb, total_mb, pause_ms of every line with
    sizes. lines: (log, line_no, line)."""
    d = lines.where(F.col("line").rlike(GC_SIZES)).withColumn("f", gc_fields(F.col("line")))
    stamp = lambda p: F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1))
    iso = F.unix_micros(F.try_to_timestamp(F.regexp_replace(stamp(ISO), r"([+-]\d{2})(\d{2})$", "$1:$2"))) / 1e6
    d = d.withColumns({"iso": iso, "uptime": F.coalesce(stamp(UPTIME), stamp(LEGACY)).cast("double")})
    first_iso = first(F.when(F.col("uptime").isNull(), F.col("iso")))
    d = running(d, ["log"], ["line_no"], {"seq": total(F.lit(1)), "first_iso": first_iso}, limit).withColumn("seq", (F.col("seq") - 1).cast("int"))
    groups = F.regexp_extract_all(F.col("f.head"), F.lit(r"\(([^)]*)\)"), F.lit(1))
    return d.select(
        "log",
        "seq",
        F.coalesce("uptime", F.col("iso") - F.col("first_iso"), F.col("seq").cast("double")).alias("ts_s"),
        F.coalesce("f.gc_id", "seq").alias("gc_id"),
        phase_of(F.col("f.head")).alias("phase"),
        F.when(F.size(groups) > 0, F.trim(F.element_at(groups, -1))).otherwise("").alias("cause"),
        "f.before_mb",
        "f.after_mb",
        "f.total_mb",
        F.coalesce("f.pause_ms", F.lit(0.0)).alias("pause_ms"),
    )


def standalone_pauses(lines: DataFrame) -> DataFrame:
    """Pauses of concurrent collectors, on lines without sizes."""
    d = lines.where(~F.col("line").rlike(GC_SIZES) & F.col("line").contains("Pause"))
    return d.select("log", F.col("line"), gc_fields(F.col("line"))["pause_ms"].alias("pause_ms")).where(F.col("line").rlike(r"\d\s*ms\b")).drop("line")


def collector(lines: DataFrame) -> DataFrame:
    """log, collector, logging: told from the first SAMPLE lines of each log."""
    head = lines.where(F.col("line_no") <= SAMPLE)
    rank = F.lit(len(COLLECTORS))
    for i in range(len(COLLECTORS) - 1, -1, -1):
        rank = F.when(F.col("line").contains(COLLECTORS[i][0]), i).otherwise(rank)
    unified = F.col("line").rlike(UPTIME) | F.col("line").rlike(ISO) | F.col("line").contains("][info][gc")
    g = head.groupBy("log").agg(F.min(rank).alias("r"), F.max(unified).alias("u"), F.count_if(F.col("line").contains("Allocation Stall")).alias("sample_stalls"))
    names = F.array(*[F.lit(n) for _, n in COLLECTORS], F.lit("Unknown"))
    return g.select("log", F.get(names, F.col("r")).alias("collector"), F.when(F.col("u"), "unified").otherwise("legacy").alias("logging"), "sample_stalls")


def pauses(ev: DataFrame, extra: DataFrame | None = None, limit: int = WINDOW_ROWS) -> DataFrame:
    """log, n_pauses, total_ms, p50, p95, p99 (interpolated), max_ms of all positive pauses."""
    p = ev.where("pause_ms > 0").select("log", "pause_ms")
    if extra is not None:
        p = p.unionByName(extra)
    g = p.groupBy("log").agg(F.count("*").alias("n_pauses"), F.sum("pause_ms").alias("total_ms"), F.max("pause_ms").alias("max_ms"))
    q = percentiles(p, ["log"], "pause_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, limit)
    return g.join(q, "log", "left").select("log", "n_pauses", "total_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")


def durations(ev: DataFrame) -> DataFrame:
    """log, gc_count, full_count, stalls, duration_s; a log without passing time lasts an event a second."""
    g = ev.groupBy("log").agg(F.count("*").alias("gc_count"), F.count_if(F.col("phase") == "full").alias("full_count"), F.count_if(F.col("phase") == "stall").alias("stalls"), (F.max("ts_s") - F.min("ts_s")).alias("d"))
    return g.select("log", "gc_count", "full_count", "stalls", F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("gc_count").cast("double")).alias("duration_s"))


def throughput(ev: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    d = durations(ev).join(pauses(ev, extra).select("log", "total_ms"), "log", "left")
    wall = F.col("duration_s") * 1000
    share = F.when(wall <= 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (wall - F.coalesce("total_ms", F.lit(0.0))) / wall * 100)))
    return d.select("log", "duration_s", share.alias("throughput_pct"))


def _sized(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("phase").isin("young", "mixed", "full"))


def allocation(ev: DataFrame, limit: int = WINDOW_ROWS) -> DataFrame:
    """log, alloc_mb: growth from each collection to the next, in input order."""
    d = running(_sized(ev), ["log"], ["seq"], {"_left": last(F.col("after_mb"))}, limit)
    grown = F.greatest(F.col("before_mb") - F.col("_left"), F.lit(0.0))
    return d.withColumn("g", F.when(F.col("_left").isNotNull(), grown)).groupBy("log").agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("alloc_mb"))


def trend(ev: DataFrame) -> DataFrame:
    """log, trend_mb_min: least-squares slope of what collections leave, 0 where undefined."""
    return _sized(ev).groupBy("log").agg((F.coalesce(F.regr_slope("after_mb", "ts_s"), F.lit(0.0)) * 60).alias("trend_mb_min"))


def baseline_reset(ev: DataFrame, limit: int = WINDOW_ROWS) -> DataFrame:
    """log, n_sized, peak_after_mb, reset: whether the last quarter falls back near the least of the first."""
    sized = _sized(ev)
    d = running(sized, ["log"], ["seq"], {"i": total(F.lit(1))}, limit).join(sized.groupBy("log").agg(F.count("*").alias("n")), "log")
    q = F.greatest(F.lit(2), F.floor(F.col("n") / 4))
    g = d.groupBy("log").agg(F.max("n").alias("n_sized"), F.min(F.when(F.col("i") <= q, F.col("after_mb"))).alias("early"), F.min(F.when(F.col("i") > F.col("n") - q, F.col("after_mb"))).alias("late"), F.max("after_mb").alias("peak_after_mb"))
    reset = (F.col("n_sized") < 8) | (F.col("late") <= F.col("early") * 1.5) | ((F.col("late") - F.col("early")) / F.greatest(F.col("early"), F.lit(1.0)) < 0.5)
    return g.select("log", "n_sized", "peak_after_mb", reset.alias("reset"))


def downsample(ev: DataFrame, cap: int = 400) -> DataFrame:
    """At most cap events per log at even steps."""
    d = ev.join(ev.groupBy("log").agg(F.count("*").alias("n")), "log").select(*ev.columns, "n")
    step = F.col("n") / cap
    k = F.ceil(F.col("seq") / step)
    keep = (F.col("n") <= cap) | ((k < cap) & (F.floor(k * step) == F.col("seq")))
    return d.where(keep).drop("n")


def summary(ev: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """All figures of each log in one row."""
    extra = standalone_pauses(lines) if lines is not None else None
    d = durations(ev)
    for part in (pauses(ev, extra), throughput(ev, extra).drop("duration_s"), allocation(ev), trend(ev), baseline_reset(ev)):
        d = d.join(part, "log", "left")
    d = d.withColumn("alloc_rate_mb_s", F.coalesce(F.try_divide(F.col("alloc_mb"), F.col("duration_s")), F.lit(0.0)))
    if lines is not None:
        d = d.join(collector(lines), "log", "left").withColumn("stalls", F.col("stalls") + F.coalesce("sample_stalls", F.lit(0)))
    return d


def findings(s: DataFrame) -> DataFrame:
    """log, rule, severity of every rule that a summary breaks."""
    pct, p99 = F.coalesce("throughput_pct", F.lit(100.0)), F.coalesce("p99_ms", F.lit(0.0))
    leak = (F.coalesce("trend_mb_min", F.lit(0.0)) > 1.0) & ~F.coalesce("reset", F.lit(True)) & (F.coalesce("n_sized", F.lit(0)) >= 8)
    rules = [
        ("leak", F.when(leak, "critical")),
        ("full_gc_or_stall", F.when((F.col("full_count") >= 5) | (F.col("stalls") >= 3), "critical").when((F.col("full_count") >= 3) | (F.col("stalls") >= 1), "warning")),
        ("throughput", F.when(pct < 70, "critical").when(pct < 90, "warning")),
        ("long_pause", F.when((pct >= 90) & (p99 > 1000), "warning")),
        ("allocation", F.when(F.col("alloc_rate_mb_s") > 512, "warning")),
    ]
    d = s.select("log", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("severity")) for n, c in rules])).alias("r"))
    return d.select("log", "r.*").where("severity is not null")


def verdict(found: DataFrame, by: str = "log") -> DataFrame:
    """critical if any finding is, degraded with a warning, else healthy."""
    g = found.groupBy(by).agg(F.max(F.col("severity") == "critical").alias("c"), F.max(F.col("severity") == "warning").alias("w"))
    return g.select(by, F.when(F.col("c"), "critical").when(F.col("w"), "degraded").otherwise("healthy").alias("verdict"))
