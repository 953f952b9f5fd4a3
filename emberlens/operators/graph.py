"""Iterative graph operators over edge tables: fixpoints with their lineage cut each round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlens.operators.contract import CORE, ROOT, WAYS, contract, dominator_tree, label_tree, labels, reached, ways_of, weights
from emberlens.session import cut_lineage, ship_package, write_table

MAX_OBJECTS = 2_000_000
#: The root where objects have numbers instead of names.
ROOT_ID = -1
#: Rounds of a search whose fronts are kept as tables of their own.
FRONTS = 16


def _united(fronts: list[DataFrame]) -> DataFrame:
    out = fronts[0]
    for f in fronts[1:]:
        out = out.unionByName(f)
    return out


def reachable(edges: DataFrame, start: DataFrame, without: DataFrame | None = None, limit: int = CORE) -> DataFrame:
    """Nodes (node) reached from start along edges (src, dst), none of ``without`` among them, however far.

    The first FRONTS rounds go a step each, with fronts stored alone. What is farther is contracted (see
    ``contract``): a core of up to ``limit`` edges is searched by one task, a larger one step by step.
    """
    e = edges.select("src", "dst")
    front = start.select("node").distinct()
    if without is not None:
        e = e.join(without.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        front = front.join(without, "node", "left_anti")
    seen, front, far = _steps(e, cut_lineage(front), FRONTS)
    if not far:
        return seen
    # edges to nodes not seen yet lead from the front or from such nodes
    seen = cut_lineage(seen)
    rest = e.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    first = front.select(F.col("node").alias("src"), F.lit(ROOT).alias("_at"))
    rest = rest.join(first, "src", "left").select(F.coalesce("_at", "src").alias("src"), "dst")
    c = contract(rest, limit)
    if c.n_core <= limit:
        ship_package(edges.sparkSession)
        core = c.core.withColumn("graph", F.lit(1)).groupBy("graph").applyInArrow(lambda t: _reach(t), "node string")
    else:
        core, _, _ = _steps(c.core, edges.sparkSession.createDataFrame([(ROOT,)], "node string"), None)
    root = edges.sparkSession.createDataFrame([(ROOT,)], "node string")
    more = reached(c, cut_lineage(core.unionByName(root).distinct())).where(F.col("node") != ROOT)
    return seen.unionByName(more)


def _steps(e: DataFrame, front: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes seen after ``most`` rounds (or all), the last front, and whether it leads on."""
    seen, k = [front], 0
    while True:
        k += 1
        nxt = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        nxt = cut_lineage(nxt.join(_united(seen), "node", "left_anti"))
        if nxt.isEmpty():
            return _united(seen), front, False
        front = nxt
        seen.append(front)
        if k == most:
            return _united(seen), front, True
        if len(seen) == FRONTS:
            seen = [cut_lineage(_united(seen))]


def _numbered(t: pa.Table, root: str | int = ROOT) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names of all nodes of an edge table, the root first, and the ends of its edges as their places."""
    src, dst = t["src"].combine_chunks(), t["dst"].combine_chunks()
    names = pc.unique(pa.concat_arrays([pa.array([root], src.type), src, dst]))
    return names, pc.index_in(src, value_set=names).to_numpy().astype(np.int64), pc.index_in(dst, value_set=names).to_numpy().astype(np.int64)


def _reach(t: pa.Table) -> pa.Table:
    names, src, dst = _numbered(t)
    order = np.argsort(src, kind="stable")
    to, first = dst[order], np.searchsorted(src[order], np.arange(len(names) + 1)).tolist()
    to, seen, todo = to.tolist(), bytearray(len(names)), [0]
    seen[0] = 1
    while todo:
        v = todo.pop()
        for u in to[first[v] : first[v + 1]]:
            if not seen[u]:
                seen[u] = 1
                todo.append(u)
    return pa.table({"node": names.take(pa.array(np.flatnonzero(np.frombuffer(seen, dtype=np.uint8))))})


def distances(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """node, depth of the shortest way from start; a depth, where given, is the farthest that is looked for."""
    e = edges.select("src", "dst")
    seen = front = cut_lineage(start.select("node").distinct().withColumn("depth", F.lit(0)))
    k = 0
    while depth is None or k < depth:
        k += 1
        front = cut_lineage(front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    return seen


def cycles(step: DataFrame) -> DataFrame:
    """node, cycle (its least member) of the nodes on cycles of a functional graph (node, next).

    Steps are doubled until the nodes that are reached no longer become fewer: those are the nodes on
    cycles, after as many rounds as the longest way into a cycle has binary digits. Their least members
    spread by doubling as well.
    """
    step = write_table(step.select("node", "next"), "cycles")
    d, reached = step, None
    while True:
        ends = write_table(d.select(F.col("next").alias("node")).distinct(), "cycles")
        n = ends.count()
        if n == reached or not n:
            break
        reached = n
        ahead = d.select(F.col("node").alias("next"), F.col("next").alias("far"))
        d = write_table(d.join(ahead, "next").select("node", F.col("far").alias("next")), "cycles")
    d = step.join(ends, "node", "left_semi")
    d = d.withColumn("cycle", F.least("node", "next"))
    while True:  # doubles its reach each round
        ahead = d.select(F.col("node").alias("next"), F.col("next").alias("far"), F.col("cycle").alias("other"))
        nxt = write_table(d.join(ahead, "next").select("node", F.col("far").alias("next"), F.least("cycle", "other").alias("cycle"), (F.col("other") < F.col("cycle")).alias("moved")), "cycles")
        d = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    return d.select("node", "cycle")


def retained_without(edges: DataFrame, roots: DataFrame, removed: DataFrame) -> DataFrame:
    """Nodes that are reached only through the removed ones, those included: with and without them."""
    e = cut_lineage(edges.select("src", "dst"))
    return reachable(e, roots).join(reachable(e, roots, without=removed), "node", "left_anti")


def paths_to_roots(edges: DataFrame, roots: DataFrame, targets: DataFrame, depth: int = 40, per_target: int = 5) -> DataFrame:
    """Shortest ways from each target back to a root: target, root, hops, path (array from the root), partial:
    whether ways of more than ``depth`` steps were left. A target all whose ways are longer has one row that
    says so, with nulls."""
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("up"))
    r = roots.select(F.col("node").alias("at")).distinct().withColumn("is_root", F.lit(True))
    front = cut_lineage(targets.select(F.col("node").alias("target"), F.col("node").alias("at"), F.array("node").alias("path")))
    out = None
    w = Window.partitionBy("target").orderBy("path")
    for k in range(depth + 1):
        hit = front.join(r, "at").select("target", F.col("at").alias("root"), F.lit(k).alias("hops"), "path")
        out = hit if out is None else out.unionByName(hit)
        front = front.join(r, "at", "left_anti").join(back, "at").where(~F.array_contains("path", F.col("up")))
        front = front.select("target", F.col("up").alias("at"), F.concat(F.array("up"), F.col("path")).alias("path"))
        # of ways that meet in one node at one distance the first is enough
        meet = Window.partitionBy("target", "at").orderBy("path")
        front = cut_lineage(front.withColumn("k", F.row_number().over(meet)).where("k = 1").drop("k"))
        if front.isEmpty():
            break
    more = front.select("target", F.lit(True).alias("partial")).distinct()
    best = out.withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy("hops", "path"))).where(F.col("k") <= per_target).drop("k")
    return best.join(more, "target", "full").select("target", "root", "hops", "path", F.coalesce("partial", F.lit(False)).alias("partial"))


def immediate_dominators(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Immediate dominators from node 0 by intersection in reverse postorder; -1 where unreachable."""
    order = np.argsort(src, kind="stable")
    to, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    number, post, seen = np.full(n, -1, dtype=np.int64), [], np.zeros(n, dtype=bool)
    stack, at = [0], [int(first[0])]
    seen[0] = True
    while stack:
        v, k = stack[-1], at[-1]
        if k < first[v + 1]:
            at[-1] = k + 1
            u = int(to[k])
            if not seen[u]:
                seen[u] = True
                stack.append(u)
                at.append(int(first[u]))
        else:
            post.append(v)
            stack.pop(), at.pop()
    rpo = post[::-1]
    for i, v in enumerate(rpo):
        number[v] = i
    keep = (number[src] >= 0) & (number[dst] > 0)
    a, b = number[src[keep]], number[dst[keep]]
    o = np.argsort(b, kind="stable")
    pred, pfirst = a[o].tolist(), np.searchsorted(b[o], np.arange(len(rpo) + 1)).tolist()
    idom = [0] + [-1] * (len(rpo) - 1)
    changed = True
    while changed:
        changed = False
        for v in range(1, len(rpo)):
            new = -1
            for p in pred[pfirst[v] : pfirst[v + 1]]:
                if idom[p] < 0:
                    continue
                if new < 0:
                    new = p
                    continue
                x = p
                while x != new:
                    while x > new:
                        x = idom[x]
                    while new > x:
                        new = idom[new]
            if idom[v] != new:
                idom[v], changed = new, True
    out = np.full(n, -1, dtype=np.int64)
    r = np.array(rpo, dtype=np.int64)
    out[r] = r[np.array(idom, dtype=np.int64)]
    return out


def _dominate(t: pa.Table) -> pa.Table:
    kind = t["kind"].combine_chunks()
    of = lambda k: t.filter(pc.equal(kind, k))
    objects, edges, roots = of("o"), of("e"), of("r")
    known = objects.group_by("a").aggregate([("size", "sum")]).sort_by("a")
    names = pa.concat_arrays([pa.array([ROOT], pa.string()), known["a"].combine_chunks().cast(pa.string())])
    shallow = np.concatenate([[0], known["size_sum"].to_numpy().astype(np.int64)])
    place = lambda c: pc.fill_null(pc.index_in(c, value_set=names[1:]), -1).to_numpy().astype(np.int64) + 1
    src, dst, top = place(edges["a"]), place(edges["b"]), place(roots["a"])
    both = (src > 0) & (dst > 0)
    src, dst = np.concatenate([src[both], np.zeros(int((top > 0).sum()), dtype=np.int64)]), np.concatenate([dst[both], top[top > 0]])
    idom = immediate_dominators(len(names), src, dst)
    found = pa.array(np.flatnonzero(idom >= 0))
    one = np.ones(len(found), dtype=np.int64)
    tree = pa.table({"node": names.take(found), "parent": names.take(pa.array(idom[found.to_numpy()])), "weight": shallow[found.to_numpy()], "size": one, "span": one})
    out = label_tree(tree)
    # both are in order of the node
    parent = tree.sort_by("node")["parent"]
    out = out.sort_by("node")
    return pa.table({"node": out["node"], "parent": parent, "depth": out["depth"], "retained": out["weight"], "pre": out["pre"], "last": out["last"]})


def _core_ways(t: pa.Table) -> pa.Table:
    names, src, dst = _numbered(t, ROOT_ID)
    return ways_of(names, immediate_dominators(len(names), src, dst))


DOMINATORS = "node string, parent string, depth bigint, retained bigint, pre bigint, last bigint"


def dominators(objects: DataFrame, edges: DataFrame, roots: DataFrame, limit: int = CORE, places: bool = True) -> DataFrame:
    """node, parent, depth, retained, pre, last of every object reached from the virtual root 0x0; the nodes that
    one dominates are those whose pre lies between its pre and its last. Without places: node, parent, retained.

    objects: (oid, shallow); edges: (src, dst), strong ones; roots: (node). Heaps of up to ``limit`` objects and
    four times as many edges are answered by one task. Larger ones are contracted (see ``contract``) and only
    their core meets in one task, which refuses more than MAX_OBJECTS edges; dominators of the core are
    carried back to all objects, and depths, sizes and places come from contracting the tree.
    """
    spark = objects.sparkSession
    ship_package(spark)
    if objects.count() <= limit and edges.count() <= 4 * limit:
        o = objects.select(F.lit("o").alias("kind"), F.col("oid").alias("a"), F.lit(None).cast("string").alias("b"), F.col("shallow").cast("bigint").alias("size"))
        e = edges.select(F.lit("e").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).cast("bigint").alias("size"))
        r = roots.select(F.lit("r").alias("kind"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).cast("bigint").alias("size"))
        found = o.unionByName(e).unionByName(r).withColumn("heap", F.lit(1)).groupBy("heap").applyInArrow(lambda t: _dominate(t), DOMINATORS)
        return found if places else found.select("node", "parent", "retained")
    # from here to the end objects are numbers
    known = write_table(objects.groupBy("oid").agg(F.sum("shallow").cast("bigint").alias("weight")).withColumn("id", F.monotonically_increasing_id()), "graph")
    # each object is there once, so that a partition of them can be hashed instead of sorting the other side
    number = lambda name, out: known.select(F.col("oid").alias(name), F.col("id").alias(out)).hint("shuffle_hash")
    top = roots.select(F.col("node").alias("oid")).join(number("oid", "dst"), "oid").select(F.lit(ROOT_ID).cast("bigint").alias("src"), "dst")
    e = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).join(number("_src", "src"), "_src").join(number("_dst", "dst"), "_dst").select("src", "dst")
    c = contract(e.unionByName(top), limit, ROOT_ID)
    if c.n_core > MAX_OBJECTS:
        raise ValueError(f"the core keeps {c.n_core} edges; the dominator kernel holds {MAX_OBJECTS}")
    # an edge of the root to itself makes sure that there is a group
    loop = spark.createDataFrame([(ROOT_ID, ROOT_ID)], "src bigint, dst bigint")
    core = c.core.unionByName(loop).withColumn("graph", F.lit(1)).groupBy("graph").applyInArrow(lambda t: _core_ways(t), WAYS)
    tree = write_table(dominator_tree(c, write_table(core, "graph")), "graph")
    # the root, which many have as their parent, isn't looked up
    named = tree.where(F.col("parent") != ROOT_ID).join(number("up", "parent"), "parent").select("node", "parent", "up")
    named = named.unionByName(tree.where(F.col("parent") == ROOT_ID).select("node", "parent", F.lit(ROOT).alias("up")))
    tree = named.join(known.withColumnRenamed("id", "node").hint("shuffle_hash"), "node", "left")
    tree = write_table(tree.select("node", "parent", F.coalesce("oid", F.lit(ROOT)).alias("oid"), "up", F.coalesce("weight", F.lit(0)).alias("weight")), "graph")
    if not places:
        return weights(tree, max(limit, 1)).select(F.col("oid").alias("node"), F.col("up").alias("parent"), F.col("weight").alias("retained"))
    found = tree.select("node", "oid", "up").join(labels(tree, max(limit, 1)).hint("shuffle_hash"), "node")
    return found.select(F.col("oid").alias("node"), F.col("up").alias("parent"), "depth", F.col("weight").alias("retained"), "pre", "last")
