"""Flows made by counting, with planted defects and the table that tells them.

Every record is a function of (seed, episode, step) over a range of numbers, so any part can be made anywhere, at
any size, again and again: no state, no window, no shuffle. Episodes take one of five shapes: a line, a loop
over one site, calls within calls, two sites in turns, and a queue whose steps take ten times as long. A
share of them has a defect: its tail is cut off (TRUNCATION), one site is another one (DIVERGENCE), or one
step takes fifty times as long (TIMING). Defects lie behind the third site and before the last, so that clusters
by the first three sites stay what they are; the first and the last round of episodes have none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.config import FlowConfig

#: Sites of each shape, in order.
SHAPES = {
    "line": ("door.open", "form.read", "form.check", "price.ask", "stock.take", "bill.write", "door.close"),
    "loop": ("job.begin", "page.list", "page.first", "page.next", "page.sum", "page.store", "job.end"),
    "calls": ("shop.enter", "cart.enter", "item.enter", "item.leave", "cart.leave", "shop.leave"),
    "turns": ("game.deal", "white.move", "black.move", "white.turn", "black.turn", "game.score", "game.over"),
    "queue": ("ticket.draw", "ticket.wait", "ticket.call", "desk.greet", "desk.serve", "ticket.done"),
}
#: The site that a loop repeats, and how often at most.
AGAIN, TIMES = "page.next", 5
KINDS = ("TRUNCATION", "DIVERGENCE", "TIMING")
STEP_MS, SLOW, LATE, LONGEST_MS = 40, 10, 50, 100_000
FACTOR, MODULUS = 1_103_515_245, 1 << 32


@dataclass(frozen=True)
class Scenario:
    """episodes over threads in turn; one in ``rare`` on average has a defect (0: none)."""

    episodes: int
    threads: int = 16
    rare: int = 50
    seed: int = 1

    def config(self) -> FlowConfig:
        """What finds its flows."""
        ends = [s for s in SHAPES.values()]
        return FlowConfig(strategy="entry_marker", entry_sites=tuple(s[0] for s in ends), terminal_sites=tuple(s[-1] for s in ends), signature_k=3, censor_margin_ms=0)


def draw(seed: int, kind: int, *counters: Column) -> Column:
    """A number below 2**20 for counters below 2**31."""
    x = F.lit(seed * 7_919 + kind * 104_729).cast("bigint")
    for c in (*counters, F.lit(kind)):
        x = ((x + c.cast("bigint")) * FACTOR) % MODULUS
        x = x.bitwiseXOR(F.shiftright(x, 15))
    return F.shiftright(x, 12)


def episodes(spark: SparkSession, s: Scenario) -> DataFrame:
    """n, thread, turn (of the thread, from 1), shape, kind (of the defect, else null), at (its place)."""
    d = spark.range(s.episodes).withColumnRenamed("id", "n")
    shape = F.get(F.array(*[F.lit(x) for x in SHAPES]), (draw(s.seed, 1, F.col("n")) % len(SHAPES)).cast("int"))
    d = d.select("n", F.format_string("worker-%03d", F.col("n") % s.threads).alias("thread"), (F.floor(F.col("n") / s.threads) + 1).alias("turn"), shape.alias("shape"))
    inner = (F.col("n") >= s.threads) & (F.col("n") < s.episodes - s.threads - s.episodes % s.threads)
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (draw(s.seed, 3, F.col("n")) % len(KINDS)).cast("int"))
    d = d.withColumn("kind", F.when(inner & (draw(s.seed, 2, F.col("n")) % s.rare == 0), kind) if s.rare else F.lit(None).cast("string"))
    length = F.element_at(F.create_map(*[x for k, v in SHAPES.items() for x in (F.lit(k), F.lit(len(v)))]), F.col("shape"))
    return d.withColumn("at", F.when(F.col("kind").isNotNull(), (F.lit(3) + draw(s.seed, 4, F.col("n")) % (length - 4)).cast("int")))


def records(spark: SparkSession, s: Scenario) -> DataFrame:
    """Records as segmentation takes them: flow_key, thread_id, ts_ms, call_site, level, message, has_stack, o1, o2."""
    sites = F.create_map(*[x for k, v in SHAPES.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    d = episodes(spark, s).select("*", F.posexplode(F.element_at(sites, F.col("shape"))).alias("place", "site"))
    d = d.where((F.col("kind").isNull()) | (F.col("kind") != "TRUNCATION") | (F.col("place") < F.col("at")))
    times = F.when(F.col("site") == AGAIN, 1 + draw(s.seed, 5, F.col("n")) % TIMES).otherwise(1).cast("int")
    d = d.withColumn("again", F.explode(F.sequence(F.lit(0), times - 1)))
    site = F.when((F.col("kind") == "DIVERGENCE") & (F.col("place") == F.col("at")), F.concat(F.lit("detour."), F.col("shape"))).otherwise(F.col("site"))
    step = F.when(F.col("shape") == "queue", STEP_MS * SLOW).otherwise(STEP_MS)
    # a loop's site takes a share of its step each time, so that times of places don't depend on how often
    jitter = draw(s.seed, 6, F.col("n"), F.col("place")) % (STEP_MS // 4)
    late = F.when((F.col("kind") == "TIMING") & (F.col("place") >= F.col("at")), step * LATE).otherwise(0)
    ts = (F.col("turn") - 1) * LONGEST_MS + F.col("n") % s.threads + F.col("place") * step + jitter + F.col("again") * (STEP_MS // (2 * TIMES)) + late
    return d.select(
        F.col("thread").alias("flow_key"), F.col("thread").alias("thread_id"), ts.cast("bigint").alias("ts_ms"), site.alias("call_site"), F.lit("INFO").alias("level"),
        F.format_string("episode %d", F.col("n")).alias("message"), F.lit(False).alias("has_stack"), F.col("n").alias("o1"), (F.col("place") * TIMES + F.col("again")).cast("bigint").alias("o2"),
    )


def truth(spark: SparkSession, s: Scenario) -> DataFrame:
    """flow_key, ep, type, index, shape of every planted defect, as findings have them: a truncated flow is noticed at
    its last site, the others where they are."""
    d = episodes(spark, s).where("kind is not null")
    return d.select(F.col("thread").alias("flow_key"), F.col("turn").cast("bigint").alias("ep"), F.col("kind").alias("type"), F.when(F.col("kind") == "TRUNCATION", F.col("at") - 1).otherwise(F.col("at")).alias("index"), "shape")
