"""Running values over groups of any size: groups that are too large for a window are cut into ranges.

Rows are sorted by group and order in ranges, whatever group they belong to. Each range folds its own rows of
a group to one value, those values are folded over the ranges of the group (a row for each range), and what
came before a range is combined with the running value inside of it. So one group that has all rows is
worked on by as many tasks as there are ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.session import cut_lineage, write_table

#: Rows of the largest group up to which windows span groups.
WINDOW_ROWS = 2_000_000
#: Rows of what comes from ahead up to which they are broadcast.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Fold:
    """A running value: over = how a window folds, whole = how an aggregate of rows with the place ``_at`` does, both =
    (before, inside) combined. inclusive: the row itself counts."""

    value: Column
    over: Callable[[Column], Column]
    whole: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]
    inclusive: bool


def total(value: Column, inclusive: bool = True) -> Fold:
    """The sum of the values so far, 0 before any."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return Fold(value, F.sum, F.sum, lambda before, own: zero(before) + zero(own), inclusive)


def last(value: Column, inclusive: bool = False) -> Fold:
    """The last value so far that isn't null."""
    return Fold(value, lambda c: F.last(c, ignorenulls=True), lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("_at"))), lambda before, own: F.coalesce(own, before), inclusive)


def first(value: Column, inclusive: bool = True) -> Fold:
    """The first value so far that isn't null."""
    return Fold(value, lambda c: F.first(c, ignorenulls=True), lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("_at"))), lambda before, own: F.coalesce(before, own), inclusive)


def largest(d: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group."""
    return d.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def running(d: DataFrame, keys: Sequence[str], order: Sequence[Column | str], folds: dict[str, Fold], limit: int = WINDOW_ROWS, most: int | None = None) -> DataFrame:
    """d with a running value of each fold over the rows of each group in an order, in which no two rows tie. Null
    keys are values. Without keys all rows are one group, which is always cut. most: how many rows a group has at
    most, where that is known."""
    frame = lambda w, f: w.rowsBetween(Window.unboundedPreceding, Window.currentRow if f.inclusive else -1)
    if keys and (largest(d, keys) if most is None else most) <= limit:
        w = Window.partitionBy(*keys).orderBy(*order)
        nothing = F.lit(None)
        return d.withColumns({name: f.both(nothing, f.over(f.value).over(frame(w, f))) for name, f in folds.items()})
    s = write_table(d.orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    s = s.withColumns({"_part": F.shiftright("_at", 33), **{f"_v{i}": f.value for i, f in enumerate(folds.values())}})
    whole = s.groupBy("_part", *keys).agg(*[f.whole(F.col(f"_v{i}")).alias(f"_w{i}") for i, f in enumerate(folds.values())])
    # a row for each range of a group
    over_parts = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")
    before = over_parts.rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut_lineage(whole.select("_part", *keys, *[f.over(F.col(f"_w{i}")).over(before).alias(f"_a{i}") for i, f in enumerate(folds.values())]))
    # sorting was one shuffle, the windows are the other; the rows aren't moved for what comes from ahead
    if ahead.count() <= BROADCAST_ROWS:
        ahead = F.broadcast(ahead)
    inside = Window.partitionBy("_part", *keys).orderBy("_at")
    s = s.withColumns({f"_o{i}": f.over(F.col(f"_v{i}")).over(frame(inside, f)) for i, f in enumerate(folds.values())})
    on = [F.col("s._part") == F.col("a._part"), *[F.col(f"s.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]]
    kept = [c for c in d.columns if c not in folds]
    return s.alias("s").join(ahead.alias("a"), on).select(*[F.col(f"s.{c}").alias(c) for c in kept], *[f.both(F.col(f"a._a{i}"), F.col(f"s._o{i}")).alias(name) for i, (name, f) in enumerate(folds.items())])


def percentiles(d: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], limit: int = WINDOW_ROWS) -> DataFrame:
    """keys and interpolated quantiles of the non-null values of each group: of large groups by the places of their
    values, of small ones in a buffer."""
    d = d.where(F.col(value).isNotNull()).select(*keys, value)
    most = largest(d, keys)
    if most <= limit:
        g = d.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(q)) for q in shares.values()])).alias("q"))
        return g.select(*keys, *[F.col("q")[i].alias(name) for i, name in enumerate(shares)])
    placed = running(d, keys, [value], {"_k": total(F.lit(1))}, limit, most)
    n = d.groupBy(*keys).agg(F.count("*").alias("_n"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(float(q))).alias("at")) for name, q in shares.items()])
    want = n.withColumn("_q", F.explode(asked)).withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_q.at"), F.ceil("_q.at")))))
    on = [*[F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys], F.col("p._k") - 1 == F.col("w._place")]
    near = placed.alias("p").join(F.broadcast(want).alias("w") if want.count() <= 100_000 else want.alias("w"), on)
    near = near.select(*[F.col(f"p.{k}").alias(k) for k in keys], F.col(f"p.{value}").alias("v"), "w._q.name", "w._q.at", "w._place")
    share = F.when(F.col("at") == F.floor("at"), F.col("v")).when(F.col("_place") == F.floor("at"), (F.ceil("at") - F.col("at")) * F.col("v")).otherwise((F.col("at") - F.floor("at")) * F.col("v"))
    g = near.groupBy(*keys, "name").agg(F.sum(share).alias("v"))
    return g.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
