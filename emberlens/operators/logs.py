"""Server-log analytics over events (id, ts, level, message, exception, ...), frames and markers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.functions.text import is_user_code
from emberlens.operators.ranges import last, running
from emberlens.session import cut_lineage

BUCKET_S, BEFORE_S, AFTER_S = 600, 7_200, 1_200
#: Capture times up to which they are broadcast; more are joined by time buckets.
BROADCAST_CAPTURES = 1_000


def search(events: DataFrame, filters: Mapping[str, str] | None = None, text: str | None = None, since: str | None = None, until: str | None = None, after: int = 0, limit: int = 100) -> DataFrame:
    """A page of events behind the id ``after``: equal fields, a time range, text contained in the
    message whatever its case. One row more than asked for tells that another page follows."""
    d = events.where(F.col("id") > after)
    for c, v in (filters or {}).items():
        d = d.where(F.col(c) == v)
    if since is not None:
        d = d.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if until is not None:
        d = d.where(F.col("ts") <= F.lit(until).cast("timestamp"))
    if text:
        d = d.where(F.lower("message").contains(text.lower()))
    return d.orderBy("id").limit(limit + 1)


def levels(events: DataFrame) -> DataFrame:
    return events.groupBy("level").agg(F.count("*").alias("n"))


def exceptions(events: DataFrame, top: int = 30) -> DataFrame:
    return events.where("exception is not null").groupBy("exception").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "exception").limit(top)


def oom_groups(markers: DataFrame, top: int = 6) -> DataFrame:
    """Out-of-memory markers by detail with number, first and last event."""
    g = markers.where("kind = 'oom'").groupBy("detail").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    return g.orderBy(F.desc("n"), "detail").limit(top)


def oom_frames(markers: DataFrame, frames: DataFrame, sampled: int = 200) -> DataFrame:
    """The application frame that is first in most of the latest out-of-memory events, per detail.
    frames: (event_id, pos, class_name, method)."""
    w = Window.partitionBy("detail").orderBy(F.desc("event_id"))
    some = markers.where("kind = 'oom'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= sampled)
    own = frames.where(is_user_code(F.col("class_name")))
    first = some.join(own, "event_id").groupBy("detail", "event_id").agg(F.min_by(F.concat_ws(".", "class_name", "method"), "pos").alias("frame"))
    n = first.groupBy("detail", "frame").agg(F.count("*").alias("n"))
    return n.groupBy("detail").agg(F.max_by(F.struct("frame", "n"), F.struct("n", "frame")).alias("b")).select("detail", "b.*")


def restarts(markers: DataFrame, events: DataFrame, captures: DataFrame) -> DataFrame:
    """Per capture (capture_id, at): whether the server started between the last out-of-memory before it
    and the capture itself.

    An as-of join: captures and markers are one sequence in time, along which the last marker of each kind is
    carried in ranges. At one time an out-of-memory comes before a capture, a start behind it.
    """
    m = markers.where(F.col("kind").isin("oom", "server_start")).join(events.select(F.col("id").alias("event_id"), "ts"), "event_id").where("ts is not null")
    none = F.lit(None).cast("timestamp")
    m = m.select(F.lit(None).cast(captures.schema["capture_id"].dataType).alias("capture_id"), F.col("ts").alias("t"), F.when(F.col("kind") == "oom", 0).otherwise(2).alias("turn"), F.when(F.col("kind") == "oom", F.col("ts")).alias("oom"), F.when(F.col("kind") != "oom", F.col("ts")).alias("start"))
    c = captures.select("capture_id", F.col("at").alias("t"), F.lit(1).alias("turn"), none.alias("oom"), none.alias("start"))
    d = running(m.unionByName(c), [], ["t", "turn"], {"last_oom": last(F.col("oom")), "last_start": last(F.col("start"))}).where("turn = 1")
    # without a time nothing is before a capture; one that is asked for twice has one answer
    d = d.withColumns({x: F.when(F.col("t").isNotNull(), F.col(x)) for x in ("last_oom", "last_start")}).groupBy("capture_id").agg(F.max("last_oom").alias("last_oom"), F.max("last_start").alias("last_start"))
    return d.select("capture_id", "last_oom", F.coalesce(F.col("last_start") > F.col("last_oom"), F.lit(False)).alias("restarted"))


def redeploys(markers: DataFrame, loaders: DataFrame) -> DataFrame:
    """Deployments and removals per artifact beside its class loaders in the heap (artifact, loaders)."""
    g = markers.where(F.col("kind").isin("deploy", "undeploy")).groupBy(F.col("detail").alias("artifact")).agg(F.count_if(F.col("kind") == "deploy").alias("deploys"), F.count_if(F.col("kind") == "undeploy").alias("undeploys"))
    d = loaders.join(g, "artifact", "left").na.fill(0, ["deploys", "undeploys"])
    return d.withColumn("stale", F.greatest(F.col("loaders") - 1, F.lit(0)))


def timeline(events: DataFrame, markers: DataFrame, anchor: str, bucket_s: int = BUCKET_S) -> DataFrame:
    """Errors, warnings and markers in even buckets from two hours before the anchor, rounded down, to
    twenty minutes after it; empty buckets are zero."""
    at = F.lit(anchor).cast("timestamp")
    down = lambda c: F.timestamp_seconds(F.floor(F.unix_seconds(c) / bucket_s) * bucket_s)
    low, high = down(at - F.expr(f"interval {BEFORE_S} seconds")), at + F.expr(f"interval {AFTER_S} seconds")
    spark = events.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(low, high, F.expr(f"interval {bucket_s} seconds"))).alias("bucket"))
    within = (F.col("ts") >= low) & (F.col("ts") < high + F.expr(f"interval {bucket_s} seconds"))
    n = events.where(within).groupBy(down(F.col("ts")).alias("bucket")).agg(F.count_if(F.col("level").isin("ERROR", "FATAL")).alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"))
    m = markers.join(events.select(F.col("id").alias("event_id"), "ts"), "event_id").where(within).groupBy(down(F.col("ts")).alias("bucket")).agg(F.count("*").alias("markers"))
    return grid.join(n, "bucket", "left").join(m, "bucket", "left").na.fill(0, ["errors", "warnings", "markers"])


def error_rise(buckets: DataFrame) -> DataFrame:
    """One row: mean errors of the last three buckets and of those before, and whether they rose."""
    k = F.row_number().over(Window.orderBy(F.desc("bucket")))  # a timeline has a few dozen buckets
    d = buckets.withColumn("k", k)
    g = d.agg(F.avg(F.when(F.col("k") <= 3, F.col("errors"))).alias("late"), F.coalesce(F.avg(F.when(F.col("k") > 3, F.col("errors"))), F.lit(0.0)).alias("early"))
    return g.withColumn("rising", (F.col("late") >= 5) & (F.col("late") >= 3 * F.greatest(F.col("early"), F.lit(1.0))))


def minutes_phrase(ts: Column, capture: Column) -> Column:
    d = (F.unix_seconds(ts) - F.unix_seconds(capture)) / 60
    n = F.floor(F.abs(d) + 0.5).cast("int")
    return F.when(F.abs(d) < 1, "less than a minute from capture").when(d < 0, F.concat(n.cast("string"), F.lit(" min before capture"))).otherwise(F.concat(n.cast("string"), F.lit(" min after capture")))


def near_captures(events: DataFrame, captures: DataFrame, window_s: int, few: int = BROADCAST_CAPTURES) -> DataFrame:
    """The events within the window of any capture."""
    at = cut_lineage(captures.select("at").where("at is not null").distinct())
    span = F.expr(f"interval {window_s} seconds")
    within = lambda c: (F.col("ts") >= F.col(c) - span) & (F.col("ts") <= F.col(c) + span)
    if at.count() <= few:
        return events.join(F.broadcast(at), within("at"), "left_semi")
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / max(1, window_s))
    # of a bucket as wide as the window, the first and last capture decide for it and its neighbours
    ends = at.groupBy(bucket("at").alias("b")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    ends = ends.select("first", "last", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("bucket"))
    return events.join(ends, (bucket("ts") == F.col("bucket")) & (within("first") | within("last")), "left_semi")


def incident_matches(events: DataFrame, frames: DataFrame, classes: DataFrame, threads: DataFrame, captures: DataFrame | None = None, window_s: int = 300) -> DataFrame:
    """Events that touch the evidence: a frame or logger of a class of interest, a thread name, or an
    out-of-memory error; within the window of a capture where times are aligned, and without regard
    to time if that leaves none. Columns: id, by_frame, by_logger, by_thread, by_oom, aligned."""
    c = classes.select("class_name").distinct()
    hit = lambda d, k: d.select("id", *[F.lit(int(k == x)).alias(x) for x in ("by_frame", "by_logger", "by_thread", "by_oom")])
    parts = [
        hit(frames.join(c, "class_name", "left_semi").select(F.col("event_id").alias("id")), "by_frame"),
        hit(events.join(c.withColumnRenamed("class_name", "logger"), "logger", "left_semi"), "by_logger"),
        hit(events.join(threads.select("thread").distinct(), "thread", "left_semi"), "by_thread"),
        hit(events.where(F.col("exception").endswith("OutOfMemoryError")), "by_oom"),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    g = u.groupBy("id").agg(*[F.max(x).alias(x) for x in ("by_frame", "by_logger", "by_thread", "by_oom")])
    if captures is None:
        return g.withColumn("aligned", F.lit(False))
    near = near_captures(events, captures, window_s).select("id").withColumn("near", F.lit(True))
    d = g.join(near, "id", "left").withColumn("aligned", F.coalesce("near", F.lit(False))).drop("near")
    any_near = d.agg(F.coalesce(F.max("aligned"), F.lit(False)).alias("x")).select("x").scalar()
    return d.where(F.col("aligned") | ~any_near)


def incident_rank(matches: DataFrame, events: DataFrame, top: int = 100) -> DataFrame:
    """Matches by weight of their links, severity and id."""
    weight = F.col("by_frame") * 4 + F.col("by_oom") * 3 + F.col("by_thread") * 2 + F.col("by_logger") + F.when(F.col("aligned"), 2).otherwise(0)
    sev = F.when(F.col("level").isin("ERROR", "FATAL"), 0).when(F.col("level") == "WARN", 1).otherwise(2)
    d = matches.join(events.select("id", "level"), "id").select("id", weight.alias("score"), sev.alias("severity"))
    return d.orderBy(F.desc("score"), "severity", "id").limit(top)
