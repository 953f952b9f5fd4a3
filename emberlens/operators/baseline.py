"""Clusters of episodes and the consensus that each cluster agrees on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.operators.quantiles import nearest_rank
from emberlens.session import cut_lineage, write_table

SEPARATOR = "\u0001"
#: Clusters up to which they are broadcast.
BROADCAST_ROWS = 100_000


def signature(k: int) -> Column:
    """First k call sites as they came, repeats and all."""
    return F.array_join(F.slice("seq", 1, k), " > ")


def clusters(eps: DataFrame, k: int, least: int) -> DataFrame:
    """signature, size, under_sampled."""
    return eps.groupBy(signature(k).alias("signature")).agg(F.count("*").alias("size")).withColumn("under_sampled", F.col("size") < least)


def clustered(eps: DataFrame, k: int, least: int) -> DataFrame:
    """Episodes with signature, size and under_sampled of their cluster. They are written once; clusters are
    counted from that table, and where they are few the episodes aren't moved to them."""
    eps = write_table(eps, "episodes")
    found = cut_lineage(clusters(eps, k, least))
    d = eps.withColumn("signature", signature(k))
    if found.count() <= BROADCAST_ROWS:
        return d.join(F.broadcast(found), "signature")
    return write_table(d.join(found, "signature"), "members")


def in_window(start: Column, low: int | None, high: int | None) -> Column:
    """Half-open; an unknown start is inside only of a window without bounds."""
    if low is None and high is None:
        return F.lit(True)
    c = start.isNotNull()
    if low is not None:
        c &= start >= low
    if high is not None:
        c &= start < high
    return c


def paths(members: DataFrame) -> DataFrame:
    """Counts of whole collapsed sequences per cluster: signature, path, n, text."""
    n = members.where(F.size("path") > 0).groupBy("signature", "path").agg(F.count("*").alias("n"))
    return n.withColumn("text", F.array_join("path", SEPARATOR))


def modal(members: DataFrame) -> DataFrame:
    """signature, modal (array), modal_count, total, modal_share: the most frequent sequence, of equal ones
    the first as text."""
    p = paths(members).groupBy("signature").agg(F.min_by(F.struct("path", "n"), F.struct(-F.col("n"), "text")).alias("m"), F.sum("n").alias("total"))
    return p.select("signature", F.col("m.path").alias("modal"), F.col("m.n").alias("modal_count"), "total", (F.col("m.n") / F.col("total")).alias("modal_share"))


def alternatives(members: DataFrame, top: int) -> DataFrame:
    """The most frequent sequences behind the modal one."""
    p = paths(members)
    # a filtered rank alone, so that each task keeps the first few of a cluster only
    first = p.withColumn("rank", F.row_number().over(Window.partitionBy("signature").orderBy(F.desc("n"), "text"))).where(F.col("rank") <= top + 1)
    d = first.where("rank > 1").join(p.groupBy("signature").agg(F.sum("n").alias("total")), "signature")
    return d.select("signature", (F.col("rank") - 1).alias("rank"), "path", "n", (F.col("n") / F.col("total")).alias("share"))


def positional(members: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Options at each modal position among the episodes that reach it, with share and rank."""
    m = (modal(members) if base is None else base).select("signature", F.size("modal").alias("len"))
    at = members.select("signature", F.posexplode("path").alias("pos", "site")).join(m, "signature").where(F.col("pos") < F.col("len"))
    n = at.groupBy("signature", "pos", "site").agg(F.count("*").alias("n"))
    w = Window.partitionBy("signature", "pos")
    share = F.col("n") / F.sum("n").over(w)
    return n.select("*", share.alias("share"), F.row_number().over(w.orderBy(F.desc("n"), "site")).alias("rank"))


def steps(members: DataFrame) -> DataFrame:
    """Neighbouring runs of every episode: src, dst, index of dst, elapsed_ms (null if unknown)."""
    n = F.size("runs")
    at = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = F.transform(at, lambda i: F.struct(i.alias("index"), F.get("runs", i - 1).alias("a"), F.get("runs", i).alias("b")))
    d = members.withColumn("_s", F.explode(pair))
    elapsed = F.greatest(F.col("_s.b.first_ms") - F.col("_s.a.first_ms"), F.lit(0))
    known = F.col("_s.b.first_ms").isNotNull() & F.col("_s.a.first_ms").isNotNull()
    return d.withColumns({"src": F.col("_s.a.site"), "dst": F.col("_s.b.site"), "index": F.col("_s.index"), "elapsed_ms": F.when(known, elapsed)}).drop("_s")


def transitions(members: DataFrame) -> DataFrame:
    """src, dst, count and share of all that leaves src."""
    n = steps(members).groupBy("signature", "src", "dst").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("signature", "src")))


def timings(members: DataFrame) -> DataFrame:
    """Nearest-rank median and 95th percentile of the time of each transition."""
    return nearest_rank(steps(members), ("signature", "src", "dst"), "elapsed_ms", {"p50_ms": 0.5, "p95_ms": 0.95})


def slowest(members: DataFrame, top: int) -> DataFrame:
    return timings(members).orderBy(F.desc("p95_ms"), "signature", "src", "dst").limit(top)
