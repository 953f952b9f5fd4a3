"""Flow segmentation: records to episodes, episodes to runs.

Records carry flow_key, ts_ms, call_site, level, has_stack and their arrival order (o1, o2). Every
strategy is a state machine over the records of a flow, put as running values: one window pass where all
flows are small (the episode aggregate that follows keeps that partitioning, so segmentation costs one
shuffle), ranges that cut flows where one is large (see ``ranges``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.operators.ranges import WINDOW_ROWS, largest, last, running, total


ORDER = ("o1", "o2")


def group_key(records: DataFrame, pattern: str | None = None) -> DataFrame:
    """flow_key from the thread, or from group 1 (else the whole match) of a pattern in the message;
    records without a key go."""
    if pattern is None:
        key = F.col("thread_id")
    else:
        groups = 1 if _has_group(pattern) else 0
        key = F.nullif(F.regexp_extract("message", "(?U)" + pattern, groups), F.lit(""))
    return records.withColumn("flow_key", key).where(F.col("flow_key").isNotNull())


def _has_group(pattern: str) -> bool:
    import re

    return re.compile(pattern).groups > 0


def idle_gap(records: DataFrame, gap_ms: int, terminals: Sequence[str] = (), limit: int = WINDOW_ROWS) -> DataFrame:
    """A new episode where more than gap_ms passed since the last known time; clocks that run
    backwards and unknown times pass no time. Closed episodes saw a terminal site."""
    most = largest(records, ["flow_key"])
    d = running(records, ["flow_key"], ORDER, {"_last": last(F.col("ts_ms"))}, limit, most)
    starts = F.coalesce((F.col("ts_ms") - F.col("_last") > gap_ms).cast("int"), F.lit(0))
    d = running(d.withColumn("_new", starts), ["flow_key"], ORDER, {"ep": total(F.col("_new"))}, limit, most).drop("_new", "_last")
    return d.withColumn("closing", _among("call_site", terminals))


def entry_marker(records: DataFrame, entries: Sequence[str], terminals: Sequence[str] = (), limit: int = WINDOW_ROWS) -> DataFrame:
    """An episode opens at an entry site and ends at the next or with its first terminal site;
    records outside of episodes go."""
    opens, closes, place = _among("call_site", entries), _among("call_site", terminals), F.struct(*ORDER)
    # closed before: the last terminal site isn't before the last entry
    folds = {"ep": total(opens.cast("int")), "_opened": last(F.when(opens, place), inclusive=True), "_closed": last(F.when(closes, place))}
    d = running(records, ["flow_key"], ORDER, folds, limit).where("ep > 0 and (_closed is null or _closed < _opened)")
    return d.withColumn("closing", closes).drop("_opened", "_closed")


def correlation(records: DataFrame, terminals: Sequence[str] = (), limit: int = WINDOW_ROWS) -> DataFrame:
    """All records of a key are one episode, in time order, unknown times last."""
    late = F.coalesce(F.col("ts_ms"), F.lit(2**62))
    d = running(records, ["flow_key"], [late, *ORDER], {"_place": total(F.lit(1))}, limit)
    return d.withColumn("o1", F.col("_place").cast("bigint")).drop("_place").withColumns({"o2": F.lit(0).cast("bigint"), "ep": F.lit(0).cast("bigint"), "closing": _among("call_site", terminals)})


def _among(c: str, sites: Sequence[str]) -> Column:
    return F.coalesce(F.col(c).isin(list(sites)), F.lit(False)) if sites else F.lit(False)


def collapse(seq: Column, times: Column) -> Column:
    """Runs of equal neighbours: array<struct<site, first_ms, n>>. seq has no nulls."""
    n = F.size(seq)
    heads = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(seq, i) != F.get(seq, i - 1)))
    return F.transform(heads, lambda i, k: F.struct(F.get(seq, i).alias("site"), F.get(times, i).alias("first_ms"), (F.coalesce(F.get(heads, k + 1), n) - i).alias("n")))


def episodes(segmented: DataFrame) -> DataFrame:
    """One row per (flow_key, ep): thread_id, status, has_error, has_stack, n_records, start_ms and
    end_ms (of the first and last record, not the least and largest), seq, runs, path."""
    s = F.struct("o1", "o2", "ts_ms", "call_site", "thread_id")
    stack = F.col("has_stack") if "has_stack" in segmented.columns else F.lit(False)
    g = segmented.groupBy("flow_key", "ep").agg(
        F.sort_array(F.collect_list(s)).alias("_r"),
        F.max(F.coalesce(F.upper("level") == "ERROR", F.lit(False))).alias("has_error"),
        F.max(F.coalesce(stack, F.lit(False))).alias("has_stack"),
        F.max("closing").alias("closed"),
    )
    known = F.filter("_r", lambda r: r["call_site"].isNotNull())
    g = g.select(
        "flow_key",
        "ep",
        F.col("_r")[0]["thread_id"].alias("thread_id"),
        F.when(F.col("has_error"), "ERRORED").when(F.col("closed"), "COMPLETED").otherwise("TRUNCATED").alias("status"),
        "has_error",
        "has_stack",
        F.size("_r").cast("bigint").alias("n_records"),
        F.col("_r")[0]["ts_ms"].alias("start_ms"),
        F.element_at("_r", -1)["ts_ms"].alias("end_ms"),
        F.transform(known, lambda r: r["call_site"]).alias("seq"),
        F.transform(known, lambda r: r["ts_ms"]).alias("times"),
    )
    g = g.withColumn("runs", collapse(F.col("seq"), F.col("times"))).drop("times")
    return g.withColumn("path", F.transform("runs", lambda r: r["site"]))


def record_histogram(n: Column, bounds: Sequence[int]) -> Column:
    """Label of the first bound that n doesn't exceed, bounds inclusive."""
    c = F.lit(f">{bounds[-1]}")
    for b in reversed(bounds):
        c = F.when(n <= b, f"<={b}").otherwise(c)
    return c
