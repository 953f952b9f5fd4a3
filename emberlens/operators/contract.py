"""Graphs made small before anything needs them whole: sinks dropped and unary chains joined, round by round.

``contract`` takes a graph with one root. A sink is a node without edges out of it; a chain is a run of nodes
in which each is the only successor of the one before and has no other predecessor. Sinks go, chains become
their first node, and that repeats until the core has few edges or nothing changes. What each round took is
kept as a table, so that answers for the core can be carried back to all nodes: ``reached`` for
reachability, ``dominator_tree`` for immediate dominators. ``labels`` contracts a tree in the same way and
gives each node its interval in preorder, its depth and the weight below it.

Chains are followed by doubling, so a list of n nodes takes log n rounds. Every round is joins and partial
aggregates with its lineage cut; only the core meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.session import few, write_table

ROOT = "0x0"
#: Edges of a graph, or nodes of a tree, from which on rounds go on.
CORE = 250_000
#: Children of one node up to which one window holds them.
SIBLINGS = 500_000


def cut_lineage(d: DataFrame) -> DataFrame:
    """As a table of the shared folder: a checkpoint would keep the planner's estimates, which joins with themselves
    square in each round until their digits take longer than the data."""
    return write_table(d, "graph")


@dataclass
class Contraction:
    """core: (src, dst); rounds: (sinks (src, dst), chains (node, head, k, up), tails (head, tail)), first to last."""

    core: DataFrame
    n_core: int
    rounds: list[tuple[DataFrame, DataFrame | None, DataFrame | None]] = field(default_factory=list)


def to_heads(links: DataFrame, sums: list[str]) -> DataFrame:
    """node, head, sums: where each node's links (node, up, sums) end, with the sums of the way. Each node is
    linked to at most once. Nodes whose links run in a circle have no head and are left out."""
    todo = cut_lineage(links.select("node", F.col("up").alias("head"), *sums))
    done, before = None, None
    while True:
        ahead = todo.select(F.col("node").alias("head"), F.col("head").alias("_far"), *[F.col(s).alias(f"_{s}") for s in sums])
        if done is not None:
            over = done.select(F.col("node").alias("head"), F.col("head").alias("_far"), *[F.col(s).alias(f"_{s}") for s in sums], F.lit(True).alias("_end"))
            ahead = ahead.withColumn("_end", F.lit(False)).unionByName(over)
        else:
            ahead = ahead.withColumn("_end", F.lit(False))
        j = todo.join(ahead, "head", "left")
        j = cut_lineage(j.select("node", F.coalesce("_far", "head").alias("head"), *[(F.col(s) + F.coalesce(F.col(f"_{s}"), F.lit(0))).alias(s) for s in sums], F.coalesce("_end", F.lit(True)).alias("_end")))
        ended = j.where("_end").drop("_end")
        done = ended if done is None else done.unionByName(ended)
        todo = j.where("not _end").drop("_end")
        n = todo.count()
        if not n or n == before:
            return done
        before = n


def contract(edges: DataFrame, limit: int = CORE, root: str | int = ROOT) -> Contraction:
    """edges: (src, dst) with the edges of the root among them; those from a node to itself, and those into nodes
    that the root leads to directly, tell nothing and are left out. Edges of sinks may repeat, others don't."""
    e = cut_lineage(edges.select("src", "dst").where("src <> dst"))
    out = Contraction(e, e.count())
    while out.n_core > limit:
        e, n = out.core, out.n_core
        inner = e.select(F.col("src").alias("dst"), F.lit(True).alias("inner"), F.lit(False).alias("top"))
        if not out.rounds:
            inner = inner.unionByName(e.where(F.col("src") == root).select("dst", F.lit(False).alias("inner"), F.lit(True).alias("top")))
        inner = inner.groupBy("dst").agg(F.max("inner").alias("inner"), F.max("top").alias("top"))
        flagged = e.join(inner, "dst", "left").where((F.col("src") == root) | ~F.coalesce("top", F.lit(False)))
        flagged = cut_lineage(flagged.select("src", "dst", F.coalesce("inner", F.lit(False)).alias("inner")))
        sinks, rest = flagged.where("not inner").select("src", "dst"), flagged.where("inner").select("src", "dst")
        if not out.rounds:
            rest = cut_lineage(rest.distinct())
        ins = rest.groupBy("dst").agg(F.count("*").alias("ins"), F.min("src").alias("src")).where("ins = 1").select("src", "dst")
        single = rest.groupBy("src").agg(F.count("*").alias("outs")).where((F.col("outs") == 1) & (F.col("src") != root)).select("src")
        links = cut_lineage(ins.join(single, "src").select(F.col("dst").alias("node"), F.col("src").alias("up"), F.lit(1).cast("bigint").alias("k")))
        chains = tails = None
        if not links.isEmpty():
            ends = to_heads(links, ["k"])
            chains = cut_lineage(ends.join(links.select("node", "up"), "node"))
            tails = cut_lineage(chains.groupBy("head").agg(F.max_by("node", "k").alias("tail")))
            # links become their heads; a chain's edges out are its last node's
            kept = rest.join(links.select(F.col("node").alias("dst")), "dst", "left_anti")
            renamed = kept.join(tails.select(F.col("tail").alias("src"), "head"), "src", "left")
            rest = renamed.select(F.coalesce("head", "src").alias("src"), "dst").where("src <> dst")
        core = cut_lineage(rest)
        out.rounds.append((sinks, chains, tails))
        out.core, out.n_core = core, core.count()
        if out.n_core == n:
            break
    return out


# ---- reachability


def reached(c: Contraction, core: DataFrame) -> DataFrame:
    """node: all that the root reaches, from the nodes (node) of the core that it does."""
    seen = core
    for sinks, chains, _ in reversed(c.rounds):
        if chains is not None:
            seen = seen.unionByName(chains.join(seen.select(F.col("node").alias("head")), "head", "left_semi").select("node"))
        below = sinks.join(seen.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        seen = cut_lineage(seen.unionByName(below))
    return seen


# ---- dominators

#: node, parent (its immediate dominator) and its way: what leads to it from the root over paths of the tree, which are
#: runs of nodes downwards, named by their first node. An entry is that name with a place on the path: of the node itself
#: in the last entry, in others of where the way leaves the path. Ways in their order are the tree in preorder.
WAYS = "node bigint, parent bigint, way array<array<bigint>>"


def paths_of(names: pa.Array, parent: np.ndarray) -> pa.Table:
    """The heavy paths of a tree; parent: index of each node's parent, the root (0) its own, -1 where there is none."""
    found = np.flatnonzero(parent >= 0)
    n = len(parent)
    depth, order = depths(parent)
    size = np.ones(n, dtype=np.int64)
    up = parent.tolist()
    total = size.tolist()
    for v in reversed(order):
        if v:
            total[up[v]] += total[v]
    heavy = [-1] * n
    for v in order:
        if v and (heavy[up[v]] < 0 or total[v] > total[heavy[up[v]]]):
            heavy[up[v]] = v
    top, pos, level, above = list(range(n)), [0] * n, [0] * n, up[:]
    for v in order:
        if v and heavy[up[v]] == v:
            u = up[v]
            top[v], pos[v], level[v], above[v] = top[u], pos[u] + 1, level[u], above[u]
        elif v:
            level[v] = level[up[v]] + 1
    take = lambda x: names.take(pa.array(np.array(x)[found]))
    return pa.table({"node": names.take(pa.array(found)), "parent": take(up), "top": take(top), "pos": pa.array([[pos[v]] for v in found.tolist()], pa.list_(pa.int64())), "level": np.array(level)[found], "up": take(above)})


def depths(parent: np.ndarray) -> tuple[list[int], list[int]]:
    """The depth of each node of a tree (-1 outside of it) and its nodes from the root down."""
    up = parent.tolist()
    depth = [-1] * len(up)
    depth[0] = 0
    for v in np.flatnonzero(parent >= 0).tolist():
        chain = []
        while depth[v] < 0:
            chain.append(v)
            v = up[v]
        d = depth[v]
        for x in reversed(chain):
            d += 1
            depth[x] = d
    d = np.array(depth)
    order = np.argsort(d, kind="stable")
    return depth, order[d[order] >= 0].tolist()


def ways_of(names: pa.Array, parent: np.ndarray) -> pa.Table:
    """WAYS of a tree along its heavy paths, so that no way has more entries than the number of nodes has digits."""
    t = paths_of(names, parent)
    node, top, level = t["node"].combine_chunks(), t["top"].to_numpy(), t["level"].to_numpy()
    pos = pc.list_flatten(t["pos"]).to_numpy()
    above = pc.index_in(t["up"].combine_chunks(), value_set=node).to_numpy()
    first = np.concatenate([[0], np.cumsum(level + 1)])
    name, place = np.empty(first[-1], dtype=np.int64), np.empty(first[-1], dtype=np.int64)
    own, at = np.arange(len(level)), np.arange(len(level))
    while len(own):
        slot = first[own] + level[at]
        name[slot], place[slot] = top[at], pos[at]
        goes_on = level[at] > 0
        own, at = own[goes_on], above[at[goes_on]]
    # where a path is left is told with the number of expansions so far (none) and 0, see dominator_tree
    size = np.full(first[-1], 4)
    size[first[1:] - 1] = 2
    start = np.concatenate([[0], np.cumsum(size)])
    entry = np.zeros(start[-1], dtype=np.int64)
    entry[start[:-1]], entry[start[:-1] + 1] = name, place
    inner = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(entry))
    return pa.table({"node": node, "parent": t["parent"], "way": pa.ListArray.from_arrays(pa.array(first, pa.int32()), inner)})


def further(way: Column, *place: Column | int) -> Column:
    """A way whose last place goes on by these numbers."""
    more = F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("bigint") for x in place])
    return F.concat(F.slice(way, 1, F.size(way) - 1), F.array(F.concat(F.element_at(way, -1), more)))


def nearest_common(sinks: DataFrame, tree: DataFrame) -> DataFrame:
    """node, parent of sinks (src, dst) below the nearest common dominator of all their predecessors in the tree.

    tree: (node, parent, way, place), places in the order of the ways. What dominates the first and the last of some
    nodes in preorder dominates them all, so two numbers for each sink are enough, and each pair is looked at once.
    """
    ends = sinks.join(tree.select(F.col("node").alias("src"), "place"), "src").groupBy("dst").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    ends = cut_lineage(ends)
    side = lambda place, node, way: tree.select(F.col("place").alias(place), F.col("node").alias(node), F.col("way").alias(way))
    p = ends.select("lo", "hi").distinct().join(side("lo", "first", "a"), "lo").join(side("hi", "last", "b").drop("last"), "hi")
    same = F.transform(F.sequence(F.lit(0), F.least(F.size("a"), F.size("b")) - 1), lambda i: F.get("a", i) == F.get("b", i))
    p = p.select("lo", "hi", "first", "a", "b", (F.array_position(same, F.lit(False)) - 1).cast("int").alias("i"))
    name = lambda way, i: F.get(F.get(way, i), F.lit(0))
    # both leave a path by one node for two paths; or they are on one path, where the first leaves or is the higher node
    below = F.when(name("a", F.col("i")) != name("b", F.col("i")), name("a", F.col("i"))).otherwise(name("a", F.col("i") + 1))
    p = p.select("lo", "hi", "first", F.when(F.col("lo") != F.col("hi"), below).alias("below"))
    p = p.join(tree.select(F.col("node").alias("below"), "parent"), "below", "left").select("lo", "hi", F.coalesce("parent", "first").alias("parent"))
    return ends.join(p.hint("shuffle_hash"), ["lo", "hi"]).select(F.col("dst").alias("node"), "parent")


def dominator_tree(c: Contraction, core: DataFrame) -> DataFrame:
    """node, parent of all that the root reaches, from the WAYS of the core.

    Where chains are expanded, for the e-th time, their nodes get the head's place followed by -e and their place in
    the chain: behind the head, but before what it was expanded to earlier. A way that leaves a path by a node after t
    expansions has the node's place followed by -t and 0. If that node is expanded later it is left by the last of the
    chain, and so it is in the order: behind nodes with -t - 1, -t - 2 and so on, and before those with -t.
    """
    tree, e, left = core, 0, len(c.rounds)
    for sinks, chains, tails in reversed(c.rounds):
        left -= 1
        if chains is not None:
            e += 1
            tree = tree.join(tails.select(F.col("head").alias("parent"), "tail"), "parent", "left")
            tree = cut_lineage(tree.select("node", F.coalesce("tail", "parent").alias("parent"), "way"))
            inner = chains.join(tree.select(F.col("node").alias("head"), "way"), "head")
            tree = tree.unionByName(inner.select("node", F.col("up").alias("parent"), further(F.col("way"), -e, F.col("k")).alias("way")))
        tree = cut_lineage(tree.orderBy("way").withColumn("place", F.monotonically_increasing_id()))
        found = nearest_common(sinks, tree)
        if left:
            own = F.array(F.array("node", F.lit(0).cast("bigint")))
            found = found.join(tree.select(F.col("node").alias("parent"), "way"), "parent").select("node", "parent", F.concat(further(F.col("way"), -e, 0), own).alias("way"))
            tree = tree.select("node", "parent", "way").unionByName(found)
        else:
            tree = tree.select("node", "parent").unionByName(found)
    return tree.select("node", "parent")


# ---- labels of trees

LABELS = "pre bigint, last bigint, weight bigint, depth bigint"


def label_tree(t: pa.Table) -> pa.Table:
    """node and LABELS of a tree (node, parent, weight, size, span) in one task."""
    node, parent = t["node"].combine_chunks(), t["parent"].combine_chunks()
    order = pc.sort_indices(node)
    t, node, parent = t.take(order), node.take(order), parent.take(order)
    up = pc.index_in(parent, value_set=node).to_numpy().astype(np.int64)
    root = int(np.flatnonzero(up == np.arange(len(up)))[0])
    swap = np.arange(len(up))
    swap[[0, root]] = root, 0  # the root first
    up = swap[up][swap]
    size, weight, span = (t[c].to_numpy()[swap].tolist() for c in ("size", "weight", "span"))
    _, down = depths(up)
    own, total, sums, above = size[:], size[:], weight[:], up.tolist()
    for v in reversed(down):
        if v:
            total[above[v]] += total[v]
            sums[above[v]] += sums[v]
    pre, depth, free = [0] * len(up), [0] * len(up), [0] * len(up)
    free[0] = own[0]
    for v in down:
        if v:
            u = above[v]
            pre[v], depth[v] = free[u], depth[u] + span[u]
            free[u] += total[v]
            free[v] = pre[v] + own[v]
    return pa.table({"node": node.take(pa.array(swap)), "pre": pre, "last": [p + s - 1 for p, s in zip(pre, total)], "weight": sums, "depth": depth})


def among_siblings(d: DataFrame, counts: DataFrame) -> DataFrame:
    """d (node, parent, size) with the sizes ahead of each node among those of its parent. counts: (parent, n). The
    children of parents with more than SIBLINGS are dealt to parts by a hash, one after the other."""
    # a row for each SIBLINGS nodes at most
    hot = F.broadcast(counts.where(F.col("n") > SIBLINGS).select("parent", F.ceil(F.col("n") / SIBLINGS).alias("_parts")))
    d = d.join(hot, "parent", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("node"), F.col("_parts")), F.lit(0)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = d.where("_parts is not null").groupBy("parent", "_part").agg(F.sum("size").alias("_sum"))
    sums = sums.select("parent", "_part", F.sum("_sum").over(earlier(Window.partitionBy("parent").orderBy("_part"))).alias("_ahead"))
    own = F.sum("size").over(earlier(Window.partitionBy("parent", "_part").orderBy("node")))
    d = d.withColumn("ahead", F.coalesce(own, F.lit(0))).join(F.broadcast(sums), ["parent", "_part"], "left")
    return d.withColumn("ahead", F.col("ahead") + F.coalesce("_ahead", F.lit(0))).drop("_parts", "_part", "_ahead")


def weights(tree: DataFrame, limit: int = CORE) -> DataFrame:
    """A tree (node, parent, weight and more), which is read several times and whose root is its own parent, with the
    weight of all below each node, itself included. Leaves have theirs already and are only added to their parents, so
    nothing but the nodes with children is kept, and of their chains only the heads."""
    if tree.count() <= limit:
        one = F.lit(1).cast("bigint")
        core = tree.select("node", "parent", F.col("weight").cast("bigint").alias("weight"), one.alias("size"), one.alias("span"), F.lit(1).alias("tree"))
        kind = tree.schema["node"].dataType.simpleString()
        found = core.groupBy("tree").applyInArrow(lambda x: label_tree(x), f"node {kind}, {LABELS}").select("node", F.col("weight").alias("_all"))
        return tree.join(few(cut_lineage(found)), "node").withColumn("weight", F.col("_all")).drop("_all")
    # the root counts as inner, its own parent
    inner = few(cut_lineage(tree.select(F.col("parent").alias("node")).distinct()))
    t = tree.select("node", "parent", F.col("weight").cast("bigint").alias("weight"))
    added = t.join(inner, "node", "left_anti").groupBy(F.col("parent").alias("node")).agg(F.sum("weight").alias("_below"))
    t = t.join(inner, "node", "left_semi").join(few(cut_lineage(added)), "node", "left")
    t = cut_lineage(t.select("node", "parent", (F.col("weight") + F.coalesce("_below", F.lit(0))).alias("weight")))
    only = t.where("node <> parent").groupBy("parent").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").select("node", F.col("parent").alias("up"))
    # the root has itself as a child, so a chain never begins there
    links = cut_lineage(only.join(t.where("node <> parent").select(F.col("node").alias("up"), F.col("weight").alias("less")), "up"))
    if links.isEmpty():
        found = weights(t, limit)
    else:
        chains = cut_lineage(to_heads(links, ["less"]))
        whole = t.join(chains.select("node", "head"), "node", "left")
        sums = whole.groupBy(F.coalesce("head", "node").alias("node")).agg(F.sum("weight").alias("weight"))
        heads = whole.where("head is null").select("node", "parent")
        heads = heads.join(chains.select(F.col("node").alias("parent"), F.col("head").alias("_head")), "parent", "left").select("node", F.coalesce("_head", "parent").alias("parent"))
        found = weights(cut_lineage(heads.join(sums, "node")), limit).select("node", "weight")
        inside = chains.join(found.select(F.col("node").alias("head"), "weight"), "head").select("node", (F.col("weight") - F.col("less")).alias("weight"))
        found = found.unionByName(inside)
    found = few(cut_lineage(found.select("node", F.col("weight").alias("_all"))))
    return tree.join(found, "node", "left").withColumn("weight", F.coalesce("_all", F.col("weight").cast("bigint"))).drop("_all")


def labels(tree: DataFrame, limit: int = CORE) -> DataFrame:
    """node and LABELS of a tree (node, parent, weight), which is read several times and whose root is its own parent: place in preorder (from 0), that of
    the last node below, weight of all below, itself included, and depth. Those below a node are the nodes whose
    place lies between both."""
    one, kind = F.lit(1).cast("bigint"), tree.schema["node"].dataType.simpleString()
    t = tree.select("node", "parent", F.col("weight").cast("bigint").alias("weight"), one.alias("size"), one.alias("span"))
    n, rounds = t.count(), []
    while n > limit:
        inner = t.where("node <> parent").select(F.col("parent").alias("node"), F.lit(True).alias("inner")).distinct()
        t = cut_lineage(t.join(few(cut_lineage(inner)), "node", "left").withColumn("inner", F.coalesce("inner", F.lit(False)) | (F.col("node") == F.col("parent"))))
        leaves = t.where("not inner").drop("inner")
        added = cut_lineage(leaves.groupBy("parent").agg(F.count("*").alias("n"), F.sum("size").alias("_size"), F.sum("weight").alias("_weight")))
        leaves = among_siblings(leaves, added.select("parent", "n"))
        t = cut_lineage(t.where("inner").drop("inner").join(added.select(F.col("parent").alias("node"), "_size", "_weight"), "node", "left"))
        at = t.where("_size is not null").select(F.col("node").alias("parent"), F.col("size").alias("_base"), F.col("span").alias("hop"))
        leaves = cut_lineage(leaves.join(at, "parent").select("node", "parent", "size", "weight", (F.col("ahead") + F.col("_base")).alias("offset"), "hop"))
        t = cut_lineage(t.select("node", "parent", (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"), (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"), "span"))
        only = t.where("node <> parent").groupBy("parent").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").select("node", F.col("parent").alias("up"))
        of_up = t.select(F.col("node").alias("up"), F.col("size").alias("offset"), F.col("weight").alias("less"), F.col("span").alias("hop"))
        links = cut_lineage(only.join(of_up, "up"))
        chains = None
        if not links.isEmpty():
            chains = cut_lineage(to_heads(links, ["offset", "less", "hop"]))
            whole = t.join(chains.select("node", "head"), "node", "left")
            sums = whole.groupBy(F.coalesce("head", "node").alias("node")).agg(F.sum("weight").alias("weight"), F.sum("size").alias("size"), F.sum("span").alias("span"))
            heads = whole.where("head is null").select("node", "parent")
            heads = heads.join(chains.select(F.col("node").alias("parent"), F.col("head").alias("_head")), "parent", "left").select("node", F.coalesce("_head", "parent").alias("parent"))
            t = cut_lineage(heads.join(sums, "node"))
        rounds.append((leaves, chains))
        n = t.count()
    done = cut_lineage(t.withColumn("tree", F.lit(1)).groupBy("tree").applyInArrow(lambda x: label_tree(x), f"node {kind}, {LABELS}"))
    for leaves, chains in reversed(rounds):
        if chains is not None:
            at = done.select(F.col("node").alias("head"), "pre", "last", "weight", "depth")
            done = done.unionByName(chains.join(at, "head").select("node", (F.col("pre") + F.col("offset")).alias("pre"), "last", (F.col("weight") - F.col("less")).alias("weight"), (F.col("depth") + F.col("hop")).alias("depth")))
        at = done.select(F.col("node").alias("parent"), "pre", F.col("depth").alias("_depth"))
        below = leaves.join(at, "parent").select("node", (F.col("pre") + F.col("offset")).alias("pre"), (F.col("pre") + F.col("offset") + F.col("size") - 1).alias("last"), "weight", (F.col("_depth") + F.col("hop")).alias("depth"))
        done = cut_lineage(done.unionByName(below))
    return done
