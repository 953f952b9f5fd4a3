"""Deviations of episodes from the baseline of their cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.config import FlowConfig
from emberlens.operators import baseline as B
from emberlens.operators.quantiles import nearest_rank
from emberlens.session import cut_lineage, write_table

#: Rows of a baseline up to which it is broadcast, one sequence or option each.
BROADCAST_ROWS = 100_000
END = "<end-of-flow>"
FINDING = ("flow_key", "ep", "thread_id", "start_ms", "status", "has_error", "has_stack", "signature", "size", "type", "site", "index", "expected", "expected_share", "observed", "raw_score")


def prefix_length(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    n = F.least(F.size(a), F.size(b))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_min(F.filter(at, lambda i: F.get(a, i) != F.get(b, i))), n)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of sites. Each site becomes one character, by its place among the
    distinct sites of both: code points from 256 on, surrogates left out."""
    both = F.array_distinct(F.concat(a, b))
    place = lambda s: F.array_position(both, s) + 255
    point = lambda p: F.when(p < 0xD800, p).otherwise(p + 0x800)
    text = lambda x: F.decode(F.unhex(F.array_join(F.transform(x, lambda s: F.lpad(F.hex(point(place(s))), 8, "0")), "")), "UTF-32")
    return F.levenshtein(text(a), text(b))


def first_divergence(expected: Column, observed: Column) -> Column:
    """struct<index, site, kind>, null where observed equals or begins the expected sequence."""
    p = prefix_length(expected, observed)
    kind = F.when(p >= F.size(expected), "INSERTION").otherwise("SUBSTITUTION")
    return F.when(p < F.size(observed), F.struct(p.alias("index"), F.get(observed, p).alias("site"), kind.alias("kind")))


def _finding(d: DataFrame, kind: str, **columns: Column) -> DataFrame:
    d = d.withColumns({"type": F.lit(kind), **columns})
    return d.select(*[F.col(c).cast("double").alias(c) if c in ("expected_share", "raw_score") else F.col(c) for c in FINDING])


def truncation(d: DataFrame) -> DataFrame:
    """Episodes that aren't completed or don't end where the modal sequence does."""
    last, end = F.element_at("path", -1), F.element_at("modal", -1)
    last = F.when(F.size("path") > 0, last)
    fires = (F.col("status") != "COMPLETED") | ~F.coalesce(last == end, F.lit(False))
    modal_len = F.greatest(F.size("modal"), F.lit(1))
    raw = (modal_len - prefix_length(F.col("path"), F.col("modal"))) / modal_len
    return _finding(d.where(fires), "TRUNCATION", site=last, index=F.size("path") - 1, expected=end, expected_share=F.col("modal_share"), observed=F.col("status"), raw_score=raw)


def divergence(d: DataFrame, options: DataFrame) -> DataFrame:
    """The first site that differs from the modal sequence, against the usual site there."""
    d = d.withColumn("_d", first_divergence(F.col("modal"), F.col("path"))).where("_d is not null")
    usual = options.where("rank = 1").select(F.col("signature").alias("_sig"), F.col("pos").alias("_pos"), F.col("site").alias("_site"), F.col("share").alias("_share"))
    j = d.join(usual, (F.col("_sig") == F.col("signature")) & (F.col("_pos") == F.col("_d.index")), "left")
    share = F.coalesce("_share", "modal_share")
    return _finding(j, "DIVERGENCE", site=F.col("_d.site"), index=F.col("_d.index"), expected=F.coalesce("_site", F.lit(END)), expected_share=share, observed=F.col("_d.site"), raw_score=share)


def timing(d: DataFrame, usual: DataFrame, factor: float) -> DataFrame:
    """Transitions that took more than factor times the 95th percentile of their kind."""
    t = usual.select(F.col("signature").alias("_sig"), F.col("src").alias("_src"), F.col("dst").alias("_dst"), "p95_ms").where("p95_ms > 0")
    s = B.steps(d)
    j = s.join(t, (F.col("_sig") == F.col("signature")) & (F.col("_src") == F.col("src")) & (F.col("_dst") == F.col("dst"))).where(F.col("elapsed_ms") > F.col("p95_ms") * F.lit(float(factor)))
    times = F.col("elapsed_ms") / F.col("p95_ms")
    text = F.format_string("elapsed=%dms p95=%dms (%.1fx)", F.col("elapsed_ms"), F.col("p95_ms"), times)
    return _finding(j, "TIMING", site=F.col("dst"), index=F.col("index"), expected=F.col("src"), expected_share=F.lit(0.0), observed=text, raw_score=times)


def corpus_stats(members: DataFrame, config: FlowConfig) -> DataFrame:
    """One row: corpus_start, corpus_end, margin_ms, over all clusters."""
    ends = members.agg(F.min("start_ms").alias("corpus_start"), F.max("end_ms").alias("corpus_end"))
    if config.censor_margin_ms is not None:
        return ends.withColumn("margin_ms", F.lit(max(0, config.censor_margin_ms)).cast("bigint"))
    lasted = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    p99 = nearest_rank(members.select(F.lit(0).alias("all"), lasted.alias("lasted")).where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()), ("all",), "lasted", {"margin_ms": 0.99})
    return ends.withColumn("margin_ms", F.coalesce(p99.select("margin_ms").scalar(), F.lit(0).cast("bigint")))


def censored(members: DataFrame, stats: DataFrame) -> DataFrame:
    """members with a flag for episodes that the ends of the corpus may have cut off."""
    d = members.crossJoin(F.broadcast(stats))  # one row
    near = (F.col("start_ms") <= F.col("corpus_start") + F.col("margin_ms")) | (F.col("end_ms") >= F.col("corpus_end") - F.col("margin_ms"))
    return d.withColumn("censored", (F.col("status") != "COMPLETED") & F.coalesce(near, F.lit(False))).drop("corpus_start", "corpus_end", "margin_ms")


def judged(members: DataFrame, config: FlowConfig, base: DataFrame | None = None) -> DataFrame:
    """Sampled episodes inside the evaluation window with their baseline and the censored flag."""
    sampled = members.where(~F.col("under_sampled"))
    if base is None:
        base = B.modal(sampled.where(B.in_window(F.col("start_ms"), config.window_start, config.window_end)))
    d = censored(sampled.where(B.in_window(F.col("start_ms"), config.eval_start, config.eval_end)), cut_lineage(corpus_stats(members, config)))
    return d.join(base, "signature")


def findings(members: DataFrame, config: FlowConfig, stored: bool = False) -> DataFrame:
    """All findings of all detectors. Members are written once, and what the clusters agree on is made
    from that table; both are read by every detector. stored: members are read from a table already, as
    ``clustered`` gives them."""
    members = members if stored else write_table(members, "members")
    sampled = members.where(~F.col("under_sampled")).where(B.in_window(F.col("start_ms"), config.window_start, config.window_end))
    base = _counted(B.modal(sampled))
    d = judged(members, config, base).where(~F.col("censored"))
    out = truncation(d).unionByName(divergence(d, _counted(B.positional(sampled, base).where("rank = 1"))))
    return out.unionByName(timing(d, _counted(B.timings(sampled)), config.timing_factor))


def _counted(d: DataFrame) -> DataFrame:
    """d stored, and broadcast if it has few rows."""
    d = cut_lineage(d)
    return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d


def engine_counts(members: DataFrame, config: FlowConfig) -> DataFrame:
    """One row of counters: evaluated, censored, clusters, under-sampled clusters, skipped episodes, margin."""
    members = write_table(members, "members")
    seen = judged(members, config).agg(F.count_if(~F.col("censored")).alias("evaluated"), F.count_if("censored").alias("censored"))
    c = members.groupBy("signature").agg(F.first("under_sampled").alias("u"), F.count("*").alias("k"))
    c = c.agg(F.count("*").alias("clusters"), F.count_if("u").alias("under_sampled"), F.coalesce(F.sum(F.when(F.col("u"), F.col("k"))), F.lit(0)).alias("skipped"))
    return seen.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(corpus_stats(members, config)))  # one row each
