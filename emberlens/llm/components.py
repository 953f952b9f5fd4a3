"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlens.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (u, v), which are bigint.

    Each round hooks every node to its smallest neighbour, follows those hooks to their roots and
    contracts the edges, until none is left. All steps are equi-joins and partial aggregates; each
    round's tables are cut from their lineage.
    """
    e = cut_lineage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut_lineage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")).select(F.col("u").alias("node"), "p"))
        while True:
            up = hook.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped = cut_lineage(hook.join(up, "p").select("node", "p", "pp"))
            hook = jumped.select("node", F.col("pp").alias("p"))
            if jumped.where("p <> pp").isEmpty():
                break
        to = lambda c: hook.select(F.col("node").alias(c), F.col("p").alias(f"{c}_root"))
        e = e.join(to("u"), "u").join(to("v"), "v").where("u_root <> v_root")
        e = cut_lineage(e.select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).distinct())
        if labels is None:
            labels = hook.select("node", F.col("p").alias("component"))
        else:
            moved = hook.select(F.col("node").alias("component"), F.col("p").alias("root"))
            labels = cut_lineage(labels.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
    return labels if labels is not None else e.select(F.col("u").alias("node"), F.col("v").alias("component"))
