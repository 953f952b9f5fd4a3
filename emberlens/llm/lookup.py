"""Equi-joins of large tables with tables of counts or sums, whatever their size and the skew of the keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.session import cut_lineage

#: Rows up to which a table is broadcast, some 100 bytes each; and how many keys at most are hot beyond it.
BROADCAST_ROWS, HOT_KEYS = 200_000, 1_000


def look_up(d: DataFrame, known: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = BROADCAST_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """d with the columns of ``known``, which has one row for each different keys; null keys are values. how: inner
    or left.

    known is counted; up to ``limit`` rows it is broadcast. Beyond that, keys that more than one in ``hot_keys``
    rows of d have, hence fewer than that many, are counted and only what is known of them is broadcast;
    the other rows are shuffled, of which no key has many.
    """
    added = [c for c in known.columns if c not in keys]

    def joined(left: DataFrame, right: DataFrame, way: str) -> DataFrame:
        on = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
        return left.alias("_l").join(right.alias("_r"), on, way).select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], *[F.col(f"_r.{c}").alias(c) for c in right.columns if c not in keys])

    if known.count() <= limit:
        return joined(d, F.broadcast(known), how)
    counts = cut_lineage(d.groupBy(*keys).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") * hot_keys > total).select(*keys, F.lit(True).alias("_hot"))
    flagged = joined(d, F.broadcast(hot), "left")
    few = cut_lineage(joined(hot, known, "inner").drop("_hot"))
    often = joined(flagged.where("_hot").drop("_hot"), F.broadcast(few), how)
    seldom = joined(flagged.where("_hot is null").drop("_hot"), known, how)
    return often.unionByName(seldom).select(*d.columns, *added)
