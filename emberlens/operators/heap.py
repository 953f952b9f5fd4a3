"""Heap queries over the tables of an object graph.

objects (oid, class_id, kind, shallow, length), classes (cid, name, super, loader), edges (src, dst,
field, strength), roots (node, kind), array_hashes (oid, digest, etype), dom (node, parent, retained).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.functions.text import is_user_code, outer_class, package_of
from emberlens.operators.graph import cut_lineage, reachable
from emberlens.session import few


def histogram(objects: DataFrame, classes: DataFrame) -> DataFrame:
    """Instances and shallow bytes per class name; equal names of several loaders are one."""
    j = objects.join(few(classes.select(F.col("cid").alias("class_id"), "name")), "class_id")
    return j.groupBy(F.col("name").alias("class_name")).agg(F.count("*").alias("instances"), F.sum("shallow").alias("bytes"))


def histogram_page(hist: DataFrame, text: str = "", by_package: bool = False, sort: str = "bytes", descending: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the histogram: names that contain a text whatever its case, by class or package, ties by
    name in the direction of the sort."""
    d = hist.where(F.lower("class_name").contains(text.lower())) if text else hist
    name = package_of(F.col("class_name")) if by_package else F.col("class_name")
    d = d.groupBy(name.alias("name")).agg(F.sum("instances").alias("instances"), F.sum("bytes").alias("bytes"))
    way = F.desc if descending else F.asc
    return d.orderBy(way(sort), way("name")).offset(offset).limit(limit)


def class_chain(classes: DataFrame) -> DataFrame:
    """cid, ancestor, hops of every class, itself included."""
    up = classes.select(F.col("cid").alias("ancestor"), F.col("super").alias("next"))
    out = front = cut_lineage(classes.select("cid", F.col("cid").alias("ancestor"), F.lit(0).alias("hops")))
    k = 0
    while True:
        k += 1
        front = front.join(up, "ancestor").where("next is not null").select("cid", F.col("next").alias("ancestor"), F.lit(k).alias("hops"))
        # in a damaged dump a class may be its own ancestor
        front = cut_lineage(front.join(out.select("cid", "ancestor"), ["cid", "ancestor"], "left_anti"))
        if front.isEmpty():
            return out
        out = cut_lineage(out.unionByName(front))


def ref_fields(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """cid and number of object-typed fields, inherited ones included. fields: (cid, field, kind)."""
    own = fields.where("kind = 'object'").groupBy("cid").agg(F.count("*").alias("k")).withColumnRenamed("cid", "ancestor")
    return class_chain(classes).join(own, "ancestor").groupBy("cid").agg(F.sum("k").alias("ref_fields"))


def strong(edges: DataFrame) -> DataFrame:
    """Edges that keep objects alive: all but the referent of a reference object."""
    return edges.where((F.col("strength") != "weak") & (F.col("field") != "java.lang.ref.Reference.referent"))


def object_detail(objects: DataFrame, classes: DataFrame, edges: DataFrame, dom: DataFrame, ids: DataFrame, roots: DataFrame | None = None, first: int = 50) -> DataFrame:
    """Class, size, dominator, root kinds, number of edges in and out, and a page of the outgoing ones by
    field (the ``first``, which is the feature) of the objects asked for."""
    want = few(ids.select("oid").distinct())
    o = objects.join(want, "oid", "left_semi").join(few(classes.select(F.col("cid").alias("class_id"), "name")), "class_id", "left")
    inn = edges.join(few(ids.select(F.col("oid").alias("dst")).distinct()), "dst", "left_semi").groupBy(F.col("dst").alias("oid")).agg(F.count("*").alias("n_in"))
    mine = edges.join(few(ids.select(F.col("oid").alias("src")).distinct()), "src", "left_semi").select(F.col("src").alias("oid"), "field", F.col("dst").alias("to"))
    out = mine.groupBy("oid").agg(F.count("*").alias("n_out"))
    page = mine.withColumn("k", F.row_number().over(Window.partitionBy("oid").orderBy("field", "to"))).where(F.col("k") <= first)
    page = page.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("field", "to"))).alias("values"))
    held = dom.select(F.col("node").alias("oid"), "parent", "retained").join(want, "oid", "left_semi")
    d = o.join(held, "oid", "left").join(inn, "oid", "left").join(out, "oid", "left").join(page, "oid", "left")
    cols = ["oid", "name", "shallow", "parent", "retained", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"), "values"]
    if roots is None:
        return d.select(*cols)
    kinds = roots.select(F.col("node").alias("oid"), "kind").join(want, "oid", "left_semi").groupBy("oid").agg(F.array_sort(F.collect_set("kind")).alias("root_kinds"))
    return d.join(kinds, "oid", "left").select(*cols, "root_kinds")


def search(objects: DataFrame, classes: DataFrame, text: str, exact: bool = False, loader: str | None = None, limit: int = 100) -> DataFrame:
    """Objects of classes named so, in order of the id as text."""
    c = classes.where(F.col("name") == text) if exact else classes.where(F.lower("name").contains(text.lower()))
    if loader is not None:
        c = c.where(F.col("loader") == loader)
    return objects.join(few(c.select(F.col("cid").alias("class_id"), "name")), "class_id").select("oid", "name", "shallow").orderBy("oid").limit(limit)


def merged_paths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the ways to several targets with the targets that use each. paths: (target, path)."""
    at = F.when(F.size("path") > 1, F.sequence(F.lit(0), F.size("path") - 2)).otherwise(F.array().cast("array<int>"))
    hop = paths.select("target", F.explode(F.transform(at, lambda i: F.struct(F.get("path", i).alias("src"), F.get("path", i + 1).alias("dst")))).alias("h")).select("target", "h.*").distinct()
    j = hop.join(edges.select("src", "dst", "field"), ["src", "dst"])
    return j.groupBy("src", "dst", "field").agg(F.sort_array(F.collect_set("target")).alias("targets"))


def dom_children(dom: DataFrame, objects: DataFrame, classes: DataFrame, parent: str, by: str = "object", offset: int = 0, limit: int = 50) -> DataFrame:
    """What a node dominates directly, by object, class or loader, largest first."""
    d = dom.where((F.col("parent") == parent) & (F.col("node") != parent)).select(F.col("node").alias("oid"), "retained")
    d = d.join(objects.select("oid", "class_id", "shallow"), "oid").join(few(classes.select(F.col("cid").alias("class_id"), F.col("name"), "loader")), "class_id", "left")
    key = {"object": "oid", "class": "name", "loader": "loader"}[by]
    g = d.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum("shallow").alias("shallow"), F.sum("retained").alias("retained"))
    return g.orderBy(F.desc("retained"), "key").offset(offset).limit(limit)


def dom_top(dom: DataFrame, root: str = "0x0", top: int = 25, share: float = 0.8, hops: int = 5) -> DataFrame:
    """The largest children of the root, each with the chain of children that hold most of it."""
    d = dom.where(F.col("node") != root)
    heads = d.where(F.col("parent") == root).orderBy(F.desc("retained"), "node").limit(top).select("node", "retained", F.array("node").alias("chain"), F.col("node").alias("at"), F.col("retained").alias("size"))
    heads = cut_lineage(heads)
    for _ in range(hops):
        # of the children only those that hold most of one of the top nodes, which are few
        large = d.select(F.col("parent").alias("at"), F.col("node").alias("child"), F.col("retained").alias("child_size")).join(F.broadcast(heads.select("at", "size")), "at")
        large = large.where(F.col("child_size") >= F.col("size") * share)
        best = cut_lineage(large.groupBy("at").agg(F.min(F.struct((-F.col("child_size")).alias("less"), "child")).alias("b")).select("at", "b.child", (-F.col("b.less")).alias("child_size")))
        if best.isEmpty():
            break
        go = F.col("child").isNotNull()
        j = heads.join(F.broadcast(best), "at", "left")
        heads = cut_lineage(j.select("node", "retained", F.when(go, F.concat("chain", F.array("child"))).otherwise(F.col("chain")).alias("chain"), F.when(go, F.col("child")).otherwise("").alias("at"), F.when(go, F.col("child_size")).otherwise(F.col("size")).alias("size")))
    return heads.select("node", "retained", "chain")


def dom_subtree(dom: DataFrame, top: str) -> DataFrame:
    """All nodes below one in the dominator tree, itself included: its retained set, a range of places.
    dom: (node, pre, last)."""
    at = dom.where(F.col("node") == top).select(F.col("pre").alias("_first"), F.col("last").alias("_last")).limit(1)
    return dom.join(F.broadcast(at), F.col("pre").between(F.col("_first"), F.col("_last"))).select("node")


def roots_browse(roots: DataFrame, objects: DataFrame, classes: DataFrame, kind: str | None = None) -> DataFrame:
    r = roots.where(F.col("kind") == kind) if kind else roots
    d = r.select(F.col("node").alias("oid"), F.col("kind").alias("root_kind")).join(objects.select("oid", "class_id", "shallow"), "oid", "left")
    return d.join(few(classes.select(F.col("cid").alias("class_id"), "name")), "class_id", "left").select("oid", "root_kind", "name", "shallow")


def unreachable(objects: DataFrame, classes: DataFrame, dom: DataFrame) -> DataFrame:
    d = objects.where("kind <> 'class'").join(dom.select(F.col("node").alias("oid")), "oid", "left_anti")
    return histogram(d, classes)


def loaders(objects: DataFrame, classes: DataFrame) -> DataFrame:
    c = classes.groupBy("loader").agg(F.countDistinct("name").alias("classes"))
    o = objects.join(few(classes.select(F.col("cid").alias("class_id"), "loader")), "class_id").groupBy("loader").agg(F.count("*").alias("instances"), F.sum("shallow").alias("bytes"))
    return c.join(o, "loader", "left").na.fill(0, ["instances", "bytes"])


def suspects(dom: DataFrame, objects: DataFrame, classes: DataFrame, root: str = "0x0", least: int = 1_048_576, pct: float = 5.0) -> DataFrame:
    """Objects under the root that retain much, and classes of such objects that do so together."""
    top = dom.where((F.col("parent") == root) & (F.col("node") != root)).select(F.col("node").alias("oid"), "retained")
    total = dom.where(F.col("node") == root).select("retained").scalar()
    cut = F.greatest(F.lit(float(least)), total * F.lit(pct / 100))
    d = top.join(objects.select("oid", "class_id"), "oid").join(few(classes.select(F.col("cid").alias("class_id"), "name")), "class_id", "left")
    one = d.where(F.col("retained") >= cut).select(F.lit("object").alias("kind"), F.col("oid").alias("key"), "name", F.lit(1).cast("bigint").alias("n"), "retained")
    many = d.groupBy("name").agg(F.count("*").alias("n"), F.sum("retained").alias("retained")).where((F.col("n") > 1) & (F.col("retained") >= cut))
    return one.unionByName(many.select(F.lit("group").alias("kind"), F.col("name").alias("key"), "name", "n", "retained"))


# ---- waste


def duplicate_arrays(hashes: DataFrame, objects: DataFrame) -> DataFrame:
    """Arrays of equal content: copies and the bytes that all but the largest take."""
    j = hashes.join(objects.select("oid", "shallow", "length"), "oid")
    g = j.groupBy("etype", "digest", "length").agg(F.count("*").alias("copies"), (F.sum("shallow") - F.max("shallow")).alias("wasted"))
    return g.where("copies > 1")


def empty_arrays(objects: DataFrame) -> DataFrame:
    return objects.where((F.col("length") == 0) & F.col("kind").rlike("array|primitive")).select("oid", "kind", "shallow")


def sparse_arrays(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Object arrays of which less than half of the slots hold anything."""
    n = edges.where(F.col("field").startswith("[")).groupBy(F.col("src").alias("oid")).agg(F.count("*").alias("occupied"))
    d = objects.where("kind = 'object_array'").join(n, "oid", "left").withColumn("occupied", F.coalesce("occupied", F.lit(0)))
    return d.where(F.col("occupied") * 2 < F.col("length")).select("oid", "length", "occupied", "shallow")


def duplicate_strings(strings: DataFrame) -> DataFrame:
    """Strings of equal content. strings: (oid, digest, etype, length, coder, shallow)."""
    g = strings.groupBy("digest", "etype", "length", "coder").agg(F.count("*").alias("copies"), (F.sum("shallow") - F.max("shallow")).alias("wasted"), F.min("oid").alias("sample"))
    return g.where("copies > 1")


def thread_locals(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """thread, key, value along Thread.threadLocals -> map -> table -> entry -> key and value."""
    hop = lambda f, a, b: edges.where(F.col("field").endswith(f)).select(F.col("src").alias(a), F.col("dst").alias(b))
    d = hop("Thread.threadLocals", "thread", "map").join(hop("ThreadLocalMap.table", "map", "tab"), "map")
    d = d.join(edges.where(F.col("field").startswith("[")).select(F.col("src").alias("tab"), F.col("dst").alias("entry")), "tab")
    d = d.join(hop("Reference.referent", "entry", "key"), "entry", "left").join(hop("Entry.value", "entry", "value"), "entry", "left")
    live = objects.select(F.col("oid").alias("key"), F.lit(True).alias("known"))
    return d.join(live, "key", "left").select("thread", "entry", "key", "value", F.when(F.col("key").isNull(), "cleared").when(F.col("known"), "live").otherwise("missing").alias("key_status"))


def references(objects: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Reference classes: instances, recorded referents, bytes."""
    c = class_chain(classes).join(classes.where("name = 'java.lang.ref.Reference'").select(F.col("cid").alias("ancestor")), "ancestor", "left_semi").select(F.col("cid").alias("class_id"))
    n = edges.where("field = 'java.lang.ref.Reference.referent'").groupBy(F.col("src").alias("oid")).agg(F.count("*").alias("referents"))
    d = objects.join(c, "class_id", "left_semi").join(n, "oid", "left").join(few(classes.select(F.col("cid").alias("class_id"), "name")), "class_id")
    return d.groupBy("name").agg(F.count("*").alias("instances"), F.coalesce(F.sum("referents"), F.lit(0)).alias("referents"), F.sum("shallow").alias("bytes"))


def collections(colls: DataFrame, edges: DataFrame) -> DataFrame:
    """Size, capacity and occupied slots of collections. colls: (oid, table_oid, size, capacity)."""
    n = edges.where(F.col("field").startswith("[")).groupBy(F.col("src").alias("table_oid")).agg(F.count("*").alias("occupied"))
    return colls.join(n, "table_oid", "left").withColumn("occupied", F.coalesce("occupied", F.lit(0)))


def list_entries(edges: DataFrame, table_oid: str, size: int) -> DataFrame:
    """Slots of a list by index, empty ones included."""
    grid = edges.sparkSession.range(size).select(F.col("id").cast("int").alias("index"))
    e = edges.where((F.col("src") == table_oid) & F.col("field").startswith("[")).select(F.regexp_extract("field", r"\[(\d+)\]", 1).try_cast("int").alias("index"), F.col("dst").alias("value"))
    return grid.join(e, "index", "left")


# fixed values: fields of the nodes of hash maps
NEXT, KEY, VALUE = ("java.util.HashMap$Node.next", "java.util.HashMap$Entry.next"), ("java.util.HashMap$Node.key", "java.util.HashMap$Entry.key"), ("java.util.HashMap$Node.value", "java.util.HashMap$Entry.value")


def map_entries(maps: DataFrame, edges: DataFrame) -> DataFrame:
    """oid, node, key, value of the entries of hash maps: the nodes in their tables and all that follow in
    the bucket chains, however long; null keys and values have no edge. maps: (oid, table_oid, size)."""
    e = cut_lineage(edges.where(F.col("field").startswith("[") | F.col("field").isin(*NEXT)).select("src", "dst", "field"))
    slots = e.where(F.col("field").startswith("["))
    front = cut_lineage(maps.join(slots, F.col("table_oid") == F.col("src")).select("oid", F.col("dst").alias("node")).distinct())
    follow = e.where(F.col("field").isin(*NEXT)).select(F.col("src").alias("node"), F.col("dst").alias("next"))
    seen = front
    while True:
        front = front.join(follow, "node").select("oid", F.col("next").alias("node")).distinct()
        front = cut_lineage(front.join(seen, ["oid", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(front))
    part = lambda names, c: edges.where(F.col("field").isin(*names)).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias(c))
    return seen.join(part(KEY, "key"), "node", "left").join(part(VALUE, "value"), "node", "left").select("oid", "node", "key", "value")


def map_coverage(maps: DataFrame, entries: DataFrame) -> DataFrame:
    """oid, logical_size, found, complete: whether as many entries were found as a map says it has."""
    n = entries.groupBy("oid").agg(F.count("*").alias("found"))
    d = maps.select("oid", F.col("size").alias("logical_size")).join(n, "oid", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return d.withColumn("complete", F.col("found") == F.col("logical_size"))


def stages_of(objects: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """stage, status, reason: which analyses a heap of so many objects gets. What is over the limit of a
    stage is skipped with the reason, nothing else is."""
    n = F.col("n")
    rows = [F.struct(F.lit(stage).alias("stage"), F.lit(most).cast("bigint").alias("most")) for stage, most in limits.items()]
    d = objects.agg(F.count("*").alias("n")).select("n", F.explode(F.array(*rows)).alias("s")).select("n", "s.*")
    over = F.coalesce(n > F.col("most"), F.lit(False))
    return d.select("stage", F.when(over, "skipped").otherwise("run").alias("status"), F.when(over, F.format_string("%d objects, the limit is %d", n, "most")).alias("reason"))


def waste_report(dups: DataFrame, total: Column, least: int = 1_048_576, share: float = 0.03) -> DataFrame:
    """Whether duplicates are worth a finding, and its severity."""
    d = dups.agg(F.coalesce(F.sum("wasted"), F.lit(0)).alias("wasted"), F.count("*").alias("groups")).withColumn("pct", F.col("wasted") / total)
    sev = F.when((F.col("pct") >= 0.15) | (F.col("wasted") >= 256 * 1_048_576), "critical").when((F.col("wasted") >= least) | (F.col("pct") >= share), "warning")
    return d.withColumn("severity", sev)


# ---- deployments, findings, comparison


def duplicate_classes(classes: DataFrame, top: int = 50) -> DataFrame:
    """Names that several loaders define, generated ones left out."""
    d = classes.where(~F.col("name").rlike(r"\$\$Lambda|\$Proxy|/0x"))
    return d.groupBy("name").agg(F.countDistinct("loader").alias("loaders")).where("loaders > 1").orderBy(F.desc("loaders"), "name").limit(top)


def packages(classes: DataFrame, top: int = 3) -> DataFrame:
    """Most frequent package prefixes per loader: three segments where there are, else two."""
    p = package_of(F.col("name"))
    short = F.when(F.size(F.split(p, r"\.")) >= 3, F.substring_index(p, ".", 3)).otherwise(F.substring_index(p, ".", 2))
    n = classes.groupBy("loader", short.alias("package")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("loader").orderBy(F.desc("n"), "package"))).where(F.col("rank") <= top)


def deployments(loader_info: DataFrame, objects: DataFrame, classes: DataFrame) -> DataFrame:
    """Per loader its artifact with classes, instances and bytes; stale where another loader has the
    same artifact. loader_info: (loader, artifact)."""
    d = loader_info.join(loaders(objects, classes), "loader", "left")
    return d.withColumn("stale", F.count("*").over(Window.partitionBy("artifact")) > 1)


def thread_owners(threads: DataFrame) -> DataFrame:
    """The loader that a thread belongs to: of its class, else of its target, else its context, system
    loaders left out. threads: (thread, class_loader, target_loader, context_loader)."""
    app = lambda c: F.when(~F.col(c).isin("system", "boot", "platform"), F.col(c))
    return threads.select("thread", F.coalesce(app("class_loader"), app("target_loader"), app("context_loader")).alias("owner"))


def class_findings(hist: DataFrame) -> DataFrame:
    """Rules on single classes of a histogram."""
    total = hist.agg(F.sum("bytes").alias("t")).select("t").scalar()
    n, name, share = F.col("instances"), F.col("class_name"), F.col("bytes") / total
    boxed = name.isin("java.lang.Integer", "java.lang.Long", "java.lang.Double", "java.lang.Boolean", "java.lang.Short", "java.lang.Byte", "java.lang.Float", "java.lang.Character")
    rules = [
        ("top_class", F.when(share > 0.3, "warning")),
        ("many_instances", F.when(is_user_code(name) & (n > 100_000), "warning")),
        ("thread_locals", F.when(name.contains("ThreadLocal") & (n > 10_000), "warning")),
        ("strings", F.when((name == "java.lang.String") & (share > 0.3), "info")),
        ("boxed", F.when(boxed & (n > 1_000_000), "info")),
    ]
    d = hist.select("class_name", "instances", "bytes", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c.alias("severity")) for k, c in rules])).alias("r"))
    return d.select("class_name", "instances", "bytes", "r.*").where("severity is not null")


def static_suspects(statics: DataFrame, dom: DataFrame, top: int = 20) -> DataFrame:
    """Static fields of application classes by what they retain. statics: (class_name, field, oid)."""
    d = statics.where(is_user_code(F.col("class_name"))).dropDuplicates(["class_name", "field"])
    return d.join(dom.select(F.col("node").alias("oid"), "retained"), "oid").orderBy(F.desc("retained"), "class_name", "field").limit(top)


def compare(before: DataFrame, after: DataFrame, complete: bool = True, top: int | None = 25) -> DataFrame:
    """Difference of two histograms: all names if both are complete, else those in both."""
    side = lambda h, s: h.select("class_name", F.col("instances").alias(f"{s}_n"), F.col("bytes").alias(f"{s}_bytes"))
    d = side(before, "a").join(side(after, "b"), "class_name", "full" if complete else "inner")
    z = lambda c: F.coalesce(c, F.lit(0))
    d = d.select("class_name", (z("b_n") - z("a_n")).alias("d_instances"), (z("b_bytes") - z("a_bytes")).alias("d_bytes"), F.col("a_n").isNull().alias("is_new"))
    return d if top is None else d.orderBy(F.desc("d_bytes"), "class_name").limit(top)


def correlate(hist: DataFrame, frames: DataFrame, statics: DataFrame | None = None, top: int = 8) -> DataFrame:
    """Application classes that are large in the heap and run in threads, on the outer class; classes with
    static suspects first. frames: (thread, class_name)."""
    h = hist.where(is_user_code(F.col("class_name"))).groupBy(outer_class(F.col("class_name")).alias("cls")).agg(F.sum("bytes").alias("bytes"))
    f = frames.where(is_user_code(F.col("class_name"))).groupBy(outer_class(F.col("class_name")).alias("cls")).agg(F.countDistinct("thread").alias("threads"))
    d = h.join(f, "cls")
    s = statics.select(outer_class(F.col("class_name")).alias("cls")).distinct().withColumn("is_static", F.lit(True)) if statics is not None else None
    d = d.join(s, "cls", "left").withColumn("is_static", F.coalesce("is_static", F.lit(False))) if s is not None else d.withColumn("is_static", F.lit(False))
    return d.orderBy(F.desc("is_static"), F.desc("bytes"), "cls").limit(top)
