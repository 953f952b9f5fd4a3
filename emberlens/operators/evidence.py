"""Joins across kinds of evidence: captures, incident evidence, source locations, bounded selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from emberlens.functions.text import is_user_code, outer_class
from emberlens.operators.graph import cut_lineage
from emberlens.session import few

MAX_GAP_S = 300
# fixed values: prefixes of frames that belong to database drivers
DRIVERS = ("java.sql.", "org.postgresql.", "com.mysql.", "oracle.jdbc", "com.zaxxer.hikari", "org.mariadb.")


def compatible(pairs: DataFrame, ordered: bool = False) -> DataFrame:
    """Whether two captures may be compared: pairs (id, a_process, b_process, a_build, b_build, a_at, b_at,
    partial). Conflicting identities are incompatible, a partial dump only limits; captures taken apart by
    more than five minutes don't belong together unless ordered, when the second must be later."""
    conflict = lambda k: F.coalesce(F.col(f"a_{k}") != F.col(f"b_{k}"), F.lit(False))
    gap = F.unix_seconds("b_at") - F.unix_seconds("a_at")
    time_bad = F.coalesce(gap <= 0, F.lit(False)) if ordered else F.coalesce(F.abs(gap) > MAX_GAP_S, F.lit(False))
    reason = F.when(conflict("process"), "process").when(conflict("build"), "build").when(time_bad, "time")
    return pairs.select("id", reason.isNull().alias("compatible"), reason.alias("reason"), F.coalesce("partial", F.lit(False)).alias("limited"))


def incident_evidence(hist: DataFrame, frames: DataFrame, threads: DataFrame, top: int = 100, most_classes: int = 500, most_threads: int = 400) -> DataFrame:
    """Names that an incident is searched for: kind class or thread, name, and where it came from; the
    largest application classes, classes of frames, names of threads, each list bounded."""
    own = hist.where(is_user_code(F.col("class_name"))).orderBy(F.desc("bytes"), "class_name").limit(top)
    c = own.select(outer_class(F.col("class_name")).alias("name"), F.lit(0).alias("source")).unionByName(frames.where(is_user_code(F.col("class_name"))).select(outer_class(F.col("class_name")).alias("name"), F.lit(1).alias("source")))
    c = c.groupBy("name").agg(F.min("source").alias("source")).orderBy("source", "name").limit(most_classes)
    t = threads.select(F.col("thread").alias("name")).distinct().orderBy("name").limit(most_threads)
    names = F.array(F.lit("histogram"), F.lit("frame"))
    return c.select(F.lit("class").alias("kind"), "name", F.get(names, F.col("source")).alias("origin")).unionByName(t.select(F.lit("thread").alias("kind"), "name", F.lit("dump").alias("origin")))


def build_verified(locations: DataFrame, manifest: DataFrame) -> DataFrame:
    """locations with whether the source they point into is that of a build that the manifest (build_id,
    valid) has as valid. locations carry build_id."""
    known = manifest.where("valid and build_id is not null").select("build_id").distinct().withColumn("_v", F.lit(True))
    return locations.join(known, "build_id", "left").withColumn("verified", F.coalesce("_v", F.lit(False))).select(*locations.columns, "verified")


def database_threads(threads: DataFrame, confirmed: bool, gap_s: Column | int | None) -> DataFrame:
    """Threads that run in a database driver, if the user confirmed that snapshot and dump belong together
    and they were taken within five minutes."""
    near = F.lit(gap_s) if isinstance(gap_s, int) or gap_s is None else gap_s
    ok = F.lit(confirmed) & F.coalesce(F.abs(near) <= MAX_GAP_S, F.lit(False))
    driver = F.exists("stack", lambda f: f.rlike("^(" + "|".join(d.replace(".", r"\.") for d in DRIVERS) + ")"))
    return threads.where(ok & driver)


def allocators(references: DataFrame, frames: DataFrame) -> DataFrame:
    """Methods that both refer to a class in source (path, method, class_name) and are on a stack (thread,
    path, method)."""
    return references.join(frames, ["path", "method"]).groupBy("class_name", "path", "method").agg(F.countDistinct("thread").alias("threads"))


def locations(affected: DataFrame, known: DataFrame, most: int = 12) -> DataFrame:
    """One source location of each affected thread of a finding: its lock frame, else the first frame whose
    source is known, else the first application frame, else the top; each location once.
    affected: (finding, thread, pos, class_name, method, line, is_lock); known: (class_name)."""
    few = affected.select("finding", "thread").distinct().withColumn("k", F.row_number().over(Window.partitionBy("finding").orderBy("thread"))).where(F.col("k") <= most)
    d = affected.join(few.drop("k"), ["finding", "thread"]).join(known.select("class_name").distinct().withColumn("known", F.lit(True)), "class_name", "left")
    order = F.when(F.col("is_lock"), 0).when(F.col("known"), 1).when(is_user_code(F.col("class_name")), 2).otherwise(3)
    best = d.groupBy("finding", "thread").agg(F.min_by(F.struct("class_name", "method", "line"), F.struct(order, "pos")).alias("f"))
    return best.select("finding", "f.*").distinct()


def trimmed(items: DataFrame, budget: int, most: int = 80) -> DataFrame:
    """Items (list, name, affected, size) of a bounded selection: affected ones first, then by name, as many
    of each list as fit a common budget."""
    w = Window.partitionBy("list").orderBy(F.desc("affected"), "name")
    d = items.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    run = F.sum("size").over(Window.partitionBy(F.lit(1)).orderBy("place", "list"))  # at most ``most`` of each list
    return d.withColumn("upto", run).where(F.col("upto") <= budget).drop("upto")


def heap_threads(roots: DataFrame, traces: DataFrame, objects: DataFrame) -> DataFrame:
    """Frames and locals of threads in a heap. roots: (node, kind, thread, frame); traces: (thread, pos,
    method)."""
    local = roots.where(F.col("kind").isin("java_frame", "jni_local")).select("thread", F.col("frame").alias("pos"), F.col("node").alias("oid"))
    j = traces.join(local, ["thread", "pos"], "left").join(objects.select("oid", "shallow"), "oid", "left")
    return j.groupBy("thread", "pos", "method").agg(F.count("oid").alias("locals"), F.coalesce(F.sum("shallow"), F.lit(0)).alias("local_bytes"))


def trace_retention(edges: DataFrame, roots: DataFrame, samples: DataFrame, classes_of: DataFrame, levels: int = 6) -> DataFrame:
    """What holds sampled objects (oid, or oid and the name of its ``trace``, which else is each its own).

    References are walked backwards, all samples of a trace as one front. First come samples that a static field
    or root holds; then, of the objects that hold the front, those that a static field holds, are of an application
    class, or are roots, in this order for one object, and the first object wins: by ``row`` of edges where there is
    such a column (their place in the dump), else by kind and name. Each level keeps one predecessor of every
    object; only the winner is unfolded, so its path is one that is there.

    sample, level (of the last object that refers to nothing but the path), kind (static, field, root; null where no
    level has any, then the path is the first of the longest), holder, field, path (labels from the sample on),
    objects (of the path), partial (whether levels ended the search). classes_of: (oid, class_name).
    """
    names = classes_of.select(F.col("oid").alias("up"), "class_name")
    place = F.col("row") if "row" in edges.columns else F.lit(0)
    back = edges.where("strength = 'strong'").select(F.col("dst").alias("at"), F.col("src").alias("up"), "field", place.alias("row"))
    # names are looked up for what is met, not for every edge: few objects may hold most of them
    back = cut_lineage(back)
    static = F.col("field").startswith("static:")
    held = back.where(static).join(names, "up", "left").groupBy("at").agg(F.min_by(F.struct("up", "field", F.concat_ws(".", "class_name", F.substring("field", 8, 1 << 20)).alias("label")), F.struct("row", "up", "field")).alias("static"))
    # what leads to a class or is led to by its loader isn't a reference of an object
    back = back.where(~static & ~F.col("field").startswith("<"))
    ends = roots.select(F.col("node").alias("at")).distinct().withColumn("is_root", F.lit(True)).join(held, "at", "full")
    trace = F.col("trace") if "trace" in samples.columns else F.col("oid")
    front = samples.select(trace.alias("sample"), F.col("oid").alias("at")).distinct().join(names.withColumnRenamed("up", "at"), "at", "left")
    none = F.lit(None).cast(edges.schema["src"].dataType)
    front = cut_lineage(front.select("sample", "at", none.alias("below"), F.lit(None).cast("string").alias("field"), F.lit(0).cast("bigint").alias("row"), F.coalesce("class_name", F.lit("?")).alias("label"), F.lit(False).alias("own")))
    fronts, found = [front], []
    for k in range(levels + 1):
        here = front.join(ends, "at", "left").withColumn("kind", F.when(F.col("static").isNotNull(), "static").when(F.col("own"), "field").when(F.col("is_root"), "root"))
        rank = F.when(F.col("kind") == "static", 0).when(F.col("kind") == "field", 1).otherwise(2)
        # the object that wins, and how it is reported: by what holds it, or as the holder of the one below
        holder = F.when(F.col("kind") == "static", F.col("static.up")).otherwise(F.col("at"))
        field = F.when(F.col("kind") == "static", F.col("static.field")).when(F.col("kind") == "field", F.col("field")).otherwise("")
        end = F.when(F.col("kind") == "static", F.array("static.label")).when(F.col("kind") == "root", F.array(F.lit("a GC root"))).otherwise(F.array().cast("array<string>"))
        level = F.when(F.col("kind") == "field", k - 1).otherwise(k)
        won = F.struct(level.alias("level"), "kind", holder.alias("holder"), field.alias("field"), end.alias("path"), "at")
        first = here.where("kind is not null").groupBy("sample").agg(F.min_by(won, F.struct("row", rank, holder, field)).alias("w")).select("sample", "w.*", F.lit(False).alias("partial"))
        first = cut_lineage(first)
        found.append(first)
        if k == levels:
            break
        up = front.join(first.select("sample"), "sample", "left_anti").select("sample", F.col("at").alias("below")).join(back.withColumnRenamed("at", "below"), "below")
        for seen in fronts:
            up = up.join(seen.select("sample", F.col("at").alias("up")), ["sample", "up"], "left_anti")
        one = up.groupBy("sample", "up").agg(F.min_by(F.struct("below", "field", "row"), F.struct("row", "field", "below")).alias("e")).select("sample", "up", "e.*")
        one = cut_lineage(one)
        met = names.join(few(one.select("up").distinct()), "up", "left_semi").groupBy("up").agg(F.min("class_name").alias("class_name"))
        one = one.join(few(cut_lineage(met)), "up", "left").withColumnRenamed("up", "at")
        item = F.col("field").startswith("[")
        label = F.when(item, F.concat(F.regexp_replace(F.coalesce("class_name", F.lit("?")), r"(?:\[\])?$", ""), F.lit("[]"))).otherwise(F.col("field"))
        front = cut_lineage(one.select("sample", "at", "below", "field", F.col("row").cast("bigint").alias("row"), label.alias("label"), (~item & is_user_code(F.coalesce("class_name", F.lit("")))).alias("own")))
        if front.isEmpty():
            break
        fronts.append(front)
    out = reduce(DataFrame.unionByName, found)
    rest = fronts[0].select("sample").distinct().join(out.select("sample"), "sample", "left_anti")
    reached = reduce(DataFrame.unionByName, [f.select("sample", "at", "row", F.lit(k).alias("level")) for k, f in enumerate(fronts)]).join(rest, "sample")
    deepest = reached.groupBy("sample").agg(F.min_by(F.struct("level", "at"), F.struct(-F.col("level"), "row", "at")).alias("w"))
    deepest = deepest.select("sample", "w.level", F.lit(None).cast("string").alias("kind"), F.col("w.at").alias("holder"), F.lit("").alias("field"), F.array().cast("array<string>").alias("path"), "w.at", (F.col("w.level") == levels).alias("partial"))
    out = out.unionByName(deepest).withColumn("objects", F.array("at").cast(ArrayType(edges.schema["src"].dataType)))
    step = lambda f: f.select("sample", "at", F.col("below").alias("_below"), F.col("label").alias("_label"))
    for f in reversed(fronts):
        # an object is in one front of a trace, so the others leave the row as it is
        out = out.join(step(f), ["sample", "at"], "left")
        out = out.withColumn("path", F.when(F.col("_label").isNull(), F.col("path")).otherwise(F.concat(F.array("_label"), "path")))
        out = out.withColumn("objects", F.when(F.col("_below").isNull(), F.col("objects")).otherwise(F.concat(F.array("_below"), "objects"))).withColumn("at", F.coalesce("_below", "at")).drop("_below", "_label")
    return out.drop("at").select("sample", "level", "kind", "holder", "field", "path", "objects", "partial")


def explain(located: DataFrame, judged: DataFrame, findings: DataFrame, ranking: DataFrame, top_n: int, sampled_sites: DataFrame) -> DataFrame:
    """Why an episode was or wasn't reported: located (thread_id, at_ms, flow_key, ep), judged and findings
    of detection, ranking, and sampled_sites (signature, under_sampled) by episode."""
    d = located.join(sampled_sites, ["flow_key", "ep"], "left").join(judged.select("flow_key", "ep", "censored"), ["flow_key", "ep"], "left")
    key = ["signature", "type", "index", "site", "expected"]
    r = ranking.select(*[F.col(k).alias(f"_{k}") for k in key], "rank", "suppressed")
    f = findings.select("flow_key", "ep", *key).join(r, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left")
    g = f.groupBy("flow_key", "ep").agg(F.count("*").alias("n"), F.min("rank").alias("rank"), F.max("suppressed").alias("suppressed"))
    d = d.join(g, ["flow_key", "ep"], "left")
    why = (
        F.when(F.col("under_sampled"), "under-sampled cluster")
        .when(F.col("censored").isNull(), "outside the evaluation window")
        .when(F.col("censored"), "censored")
        .when(F.col("n").isNull(), "no finding")
        .when(F.col("rank").isNull(), "suppressed")
        .when(F.col("rank") <= top_n, "reported")
        .otherwise("ranked too low")
    )
    return d.select("thread_id", "at_ms", "ep", F.coalesce(why, F.lit("no episode")).alias("outcome"), "rank")


def constant_arrays(arrays: DataFrame) -> DataFrame:
    """Arrays whose elements are all one value: (oid, sample array, length)."""
    return arrays.where((F.col("length") > 1) & (F.size(F.array_distinct("sample")) == 1)).select("oid", "length")


def artifact_of(url: Column) -> Column:
    """Archive that a code source points into, the outermost one."""
    name = F.regexp_extract(url, r"([^/!]+\.(?:war|ear|jar))(?:[/!]|$)", 1)
    return F.when(name != "", name)
