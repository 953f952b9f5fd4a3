"""Thread-dump analytics over threads (dump, name, tid, state, daemon, cpu_ms, elapsed_s, stack array of
Class.method, held array of addresses, waits_for address; where known id, nid, and ord, the place of a
thread in its dump).

held has the monitors of a thread but for those it waits on, and its synchronizers; waits_for is the
monitor or synchronizer that it wants, whatever its state, and null for a wait that a notification ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.functions.text import stack_signature, thread_norm
from emberlens.operators import graph

# fixed values: frames that tell what a waiting thread waits for
DB_POOL = ("java.sql.", "com.zaxxer.hikari", "org.apache.tomcat.jdbc", "org.apache.commons.dbcp", "org.hibernate.", "oracle.jdbc", "com.mysql.", "org.postgresql.")
HTTP_POOL = ("org.apache.http", "okhttp3.", "java.net.http", "feign.", "org.springframework.web.client.RestTemplate")
IDLE = ("ThreadPoolExecutor.getTask", "ForkJoinPool.awaitWork", "ReferenceQueue.remove", "Finalizer$FinalizerThread.run", "ScheduledThreadPoolExecutor$DelayedWorkQueue.take")
SOCKET_READ = ("socketRead", "SocketDispatcher.read", "Net.poll", "SocketInputStream.read")


def states(threads: DataFrame) -> DataFrame:
    return threads.groupBy("dump", "state").agg(F.count("*").alias("n"), F.count_if("daemon").alias("daemons"))


def stack_groups(threads: DataFrame, least: int = 2) -> DataFrame:
    """Threads with one top of the stack: dump, signature, n, top frame, and how many are in each state."""
    d = threads.where(F.size("stack") > 0).withColumn("signature", stack_signature(F.col("stack")))
    by = d.groupBy("dump", "signature", "state").agg(F.count("*").alias("k"), F.min(F.col("stack")[0]).alias("top"))
    g = by.groupBy("dump", "signature").agg(F.sum("k").alias("n"), F.min("top").alias("top"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", "k")))).alias("states"))
    return g.where(F.col("n") >= least)


def identity(threads: DataFrame) -> Column:
    """What a thread is known by in its dump: tid, id or nid, whichever is there first, else its name."""
    parts = [F.concat(F.lit(f"{k}:"), F.col(k).cast("string")) for k in ("tid", "id", "nid") if k in threads.columns]
    return F.coalesce(*parts, F.concat(F.lit("name:"), F.col("name")))


def blocked_by(threads: DataFrame) -> DataFrame:
    """dump, waiter, holder, address, waiter_id, holder_id: a thread that wants a lock and who holds it; of
    several holders the last of the dump."""
    place = F.col("ord") if "ord" in threads.columns else F.lit(0)
    t = threads.withColumn("me", identity(threads)).withColumn("place", place)
    held = t.select("dump", "name", "me", "place", F.explode("held").alias("address"))
    held = held.groupBy("dump", "address").agg(F.max(F.struct("place", "name", "me")).alias("h")).select("dump", "address", F.col("h.name").alias("holder"), F.col("h.me").alias("holder_id"))
    w = t.where("waits_for is not null").select("dump", F.col("name").alias("waiter"), F.col("me").alias("waiter_id"), F.col("waits_for").alias("address"))
    return w.join(held, ["dump", "address"]).where("waiter_id <> holder_id").select("dump", "waiter", "holder", "address", "waiter_id", "holder_id")


def _steps(chains: DataFrame) -> DataFrame:
    """One step of each waiter: dump, waiter_id, waiter, holder_id."""
    first = chains.groupBy("dump", "waiter_id").agg(F.min(F.struct("holder_id", "waiter")).alias("s"))
    return first.select("dump", "waiter_id", F.col("s.waiter").alias("waiter"), F.col("s.holder_id").alias("holder_id"))


def deadlocks(chains: DataFrame) -> DataFrame:
    """dump, cycle (its least name), members of each cycle of waiting threads."""
    steps = graph.cut_lineage(_steps(chains))
    key = lambda c: F.concat_ws("\u0001", "dump", c)
    c = graph.cycles(steps.select(key("waiter_id").alias("node"), key("holder_id").alias("next")))
    named = c.join(steps.select(key("waiter_id").alias("node"), "dump", F.col("waiter").alias("name")), "node")
    g = named.groupBy("dump", "cycle").agg(F.min("name").alias("least"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("members"))
    return g.select("dump", F.col("least").alias("cycle"), "members")


def contention(threads: DataFrame, least: int = 3, critical: int = 10) -> DataFrame:
    g = threads.where("state = 'BLOCKED' and waits_for is not null").groupBy("dump", F.col("waits_for").alias("address")).agg(F.count("*").alias("waiters"))
    return g.where(F.col("waiters") >= least).withColumn("severity", F.when(F.col("waiters") >= critical, "critical").otherwise("warning"))


def _any_frame(frames: Column, words: Sequence[str]) -> Column:
    pattern = "|".join(w.replace(".", r"\.").replace("$", r"\$") for w in words)
    return F.exists(frames, lambda f: f.rlike(pattern))


def pool_waits(threads: DataFrame, words: Sequence[str], least: int = 5, depth: int = 15) -> DataFrame:
    """Dumps in which several threads wait for a connection of a pool."""
    d = threads.where(F.col("state").isin("WAITING", "TIMED_WAITING") & _any_frame(F.slice("stack", 1, depth), words))
    return d.groupBy("dump").agg(F.count("*").alias("waiting")).where(F.col("waiting") >= least)


def hotspots(threads: DataFrame, top: int = 3, share: float = 0.15) -> DataFrame:
    from pyspark.sql import Window

    total = threads.groupBy("dump").agg(F.count("*").alias("total"))
    g = stack_groups(threads).join(total, "dump").where(F.col("n") >= F.greatest(F.lit(5.0), F.col("total") * share))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("dump").orderBy(F.desc("n"), "signature"))).where(F.col("rank") <= top)


def chain_lengths(chains: DataFrame) -> DataFrame:
    """dump, waiter, length: threads on the way from a waiter to the end of its chain, cycles cut off."""
    step = graph.cut_lineage(_steps(chains))
    ahead = step.select("dump", F.col("waiter_id").alias("at"), F.col("holder_id").alias("far"))
    front = graph.cut_lineage(step.select("dump", "waiter_id", "waiter", F.col("holder_id").alias("at"), F.array("waiter_id", "holder_id").alias("path")))
    done = None
    while True:
        j = front.join(ahead, ["dump", "at"], "left").withColumn("go", F.coalesce(F.col("far").isNotNull() & ~F.array_contains("path", F.col("far")), F.lit(False)))
        j = graph.cut_lineage(j)
        over = j.where("not go").select("dump", "waiter", F.size("path").alias("length"))
        done = over if done is None else done.unionByName(over)
        front = j.where("go").select("dump", "waiter_id", "waiter", F.col("far").alias("at"), F.concat("path", F.array("far")).alias("path"))
        if front.isEmpty():
            return done


def pools(threads: DataFrame, least: int = 3) -> DataFrame:
    """Pools by name with digits masked: size, busy and blocked share, most common state, verdict."""
    d = threads.withColumn("pool", thread_norm(F.col("name")))
    by = d.groupBy("dump", "pool", "state").agg(F.count("*").alias("k"))
    g = by.groupBy("dump", "pool").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("state") == "RUNNABLE", F.col("k")).otherwise(0)).alias("busy"), F.sum(F.when(F.col("state") == "BLOCKED", F.col("k")).otherwise(0)).alias("blocked"), F.max_by("state", F.struct("k", "state")).alias("mode"))
    g = g.where(F.col("n") >= least).withColumns({"busy_pct": 100.0 * F.col("busy") / F.col("n"), "blocked_pct": 100.0 * F.col("blocked") / F.col("n")})
    return g.withColumn("verdict", F.when(F.col("blocked_pct") >= 50, "saturated").when(F.col("busy_pct") >= 50, "busy").otherwise("idle"))


def hot_threads(threads: DataFrame, top: int = 10) -> DataFrame:
    from pyspark.sql import Window

    pct = F.try_divide(F.col("cpu_ms"), F.col("elapsed_s") * 1000) * 100
    d = threads.select("dump", "name", pct.alias("cpu_pct")).where("cpu_pct >= 1")
    gc = F.lower("name").rlike("gc|garbage")
    d = d.withColumn("finding", F.when(gc & (F.col("cpu_pct") >= 25), "gc").when(~gc & (F.col("cpu_pct") >= 60), "app"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("dump").orderBy(F.desc("cpu_pct"), "name"))).where(F.col("rank") <= top)


def stuck_io(threads: DataFrame, least: int = 3) -> DataFrame:
    d = threads.where((F.col("state") == "RUNNABLE") & _any_frame(F.slice("stack", 1, 3), SOCKET_READ))
    return d.groupBy("dump").agg(F.count("*").alias("stuck")).where(F.col("stuck") >= least)


def coverage(threads: DataFrame) -> DataFrame:
    """Frames seen and parsed, and whether a dump gives enough evidence. threads carry rejected, a number."""
    g = threads.groupBy("dump").agg(F.count("*").alias("threads"), F.sum(F.size("stack")).alias("parsed"), F.sum("rejected").alias("rejected"))
    seen = F.col("parsed") + F.col("rejected")
    return g.withColumn("verdict", F.when(F.col("threads") == 0, "invalid").when((seen > 0) & (F.col("rejected") * 2 > seen), "insufficient_evidence").otherwise("ok"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Threads of one identity, unique on both sides, with the same stack and state, none of whose frames
    tells an idle worker, while neither time nor cpu ran backwards as far as they are known: stuck.

    classification: persistent_wait of waiting threads, active_repeated_stack of those that used cpu, else
    repeated_stack. Whether two captures may be compared is decided by ``evidence.compatible``.
    """
    cols = ("name", "state", "stack", "cpu_ms", "elapsed_s")

    def one(d: DataFrame, side: str) -> DataFrame:
        g = d.withColumn("identity", identity(d)).groupBy("identity").agg(F.count("*").alias("k"), F.first(F.struct(*cols)).alias("t"))
        return g.where("k = 1").select("identity", *[F.col(f"t.{c}").alias(f"{side}_{c}") for c in cols])

    j = one(before, "a").join(one(after, "b"), "identity")
    same = (F.col("a_state") == F.col("b_state")) & (F.col("a_stack") == F.col("b_stack")) & (F.size("a_stack") > 0) & ~_any_frame(F.col("b_stack"), IDLE)
    cpu, elapsed = F.col("b_cpu_ms") - F.col("a_cpu_ms"), F.col("b_elapsed_s") - F.col("a_elapsed_s")
    moved = F.coalesce(elapsed > 0, F.lit(True)) & F.coalesce(cpu >= 0, F.lit(True))
    kind = F.when(cpu > 0, "active_repeated_stack").when(F.col("b_state").isin("BLOCKED", "WAITING", "TIMED_WAITING"), "persistent_wait").otherwise("repeated_stack")
    return j.where(same & moved).select("identity", F.col("b_name").alias("name"), F.col("b_state").alias("state"), cpu.alias("cpu_delta_ms"), elapsed.alias("elapsed_delta_s"), kind.alias("classification"))
