"""Exact quantiles and ranks without a sort, a window or a buffer that grows with the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.session import cut_lineage

#: Width of the cells in which values are first counted.
CELL = 4_096
#: Quantiles asked for, over all groups, up to which they are broadcast to the values.
BROADCAST_ROWS = 100_000


def nearest_rank(d: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys, n and the nearest-rank quantiles of the non-null whole numbers ``value`` of each group.

    Values are counted in cells of CELL; running counts over the cells of a group find the cell in which
    each quantile lies, and only the values of that cell are counted one by one.
    """
    d = d.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("bigint").alias("_v"), F.floor(F.col(value) / CELL).alias("_c"))
    cells = cut_lineage(d.groupBy(*keys, "_c").agg(F.count("*").alias("_k")))
    n = cells.groupBy(*keys).agg(F.sum("_k").alias("n"))
    asked = n.withColumn("_q", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.col("n") * F.lit(float(q))), F.lit(1)).alias("target")) for name, q in quantiles.items()])))
    upto = F.sum("_k").over(Window.partitionBy(*keys).orderBy("_c"))
    run = cells.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_k"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    hit = run.alias("r").join(asked.alias("a"), same("r", "a")).where("_before < _q.target and _q.target <= _upto")
    hit = cut_lineage(hit.select(*[F.col(f"a.{k}").alias(k) for k in keys], "n", "_c", "_q.name", (F.col("_q.target") - F.col("_before")).alias("_left")))
    if hit.count() <= BROADCAST_ROWS:
        hit = F.broadcast(hit)
    near = d.alias("d").join(hit.alias("h"), [*same("d", "h"), F.col("d._c") == F.col("h._c")])
    near = near.groupBy(*[F.col(f"h.{k}").alias(k) for k in keys], "h.n", "h.name", "h._left", "d._v").agg(F.count("*").alias("_k"))
    passed = F.sum("_k").over(Window.partitionBy(*keys, "name").orderBy("_v"))
    found = near.withColumn("_p", passed).where("_p >= _left").groupBy(*keys, "n", "name").agg(F.min("_v").alias("_v"))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in quantiles])


def numbered(d: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """d with the place of each row in an order, from 1: sorted by ranges, numbered within each, and
    shifted by the rows of the ranges before."""
    s = cut_lineage(d.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = s.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row for each range
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return s.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn(name, own + F.col("_ahead")).drop("_at", "_part", "_ahead")
