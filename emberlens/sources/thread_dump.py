"""Threads of jstack-like dumps, from numbered lines, without any row-at-a-time code.

A quoted header begins a thread; the lines behind it are its state, frames and locks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.functions.text import found
from emberlens.sources.lines import counted, running

# fixed values: shapes of the lines of a dump
HEADER = r'^"((?:[^"\\]|\\.)*)"(?:\s+#(\d+))?(?:\s+\[\d+\])?(?:\s+(daemon))?(?:\s+prio=(\d+))?(?:\s+os_prio=-?\d+)?(?:\s+cpu=([\d.]+)ms)?(?:\s+elapsed=([\d.]+)s)?(?:\s+tid=(0x[0-9a-fA-F]+))?(?:\s+nid=(0x[0-9a-fA-F]+|\d+))?(?:\s+([^\[]+?))?(?:\s+\[(0x[0-9a-fA-F]+)\])?\s*$'
STATE = r"^\s*java\.lang\.Thread\.State:\s+(\w+)(?:\s+\(([^)]+)\))?"
FRAME = r"^\s*at\s+(?:([^\s(]+?)/)?([\w$.<>/]+)\.([\w$<>]+)(?:\((?:[^@)]+@[\w.+]+/)?([^:)]+?)(?::(\d+))?\))?\s*$"
LOCK = r"^\s*-\s+(locked|waiting to lock|waiting on|parking to wait for)\s*<(0x[0-9a-fA-F]+)>(?:\s+\(a\s+([^)]+)\))?"
SYNC_HEAD, SYNC_ITEM = r"^\s*Locked ownable synchronizers:", r"^\s*-\s+<(0x[0-9a-fA-F]+)>"
CYCLE = r"^Found (?:one|\d+)\s+Java-level deadlock"


def _hint(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("waiting for monitor entry"), "BLOCKED").when(low.contains("runnable"), "RUNNABLE").when(low.contains("waiting on condition") | low.contains("object.wait") | low.contains("parked"), "WAITING").when(low.contains("sleeping"), "TIMED_WAITING").otherwise("UNKNOWN")


def threads(lines: DataFrame) -> DataFrame:
    """dump, name, id, tid, nid, daemon, priority, state, state_detail, cpu_ms, elapsed_s, stack (array of
    Class.method), frames, held, waits_for, rejected (frame lines not understood), ord (place in the dump). One file is one dump;
    a line that tells a deadlock ends its threads."""
    line = F.col("line")
    d = counted(lines, after=line.rlike(CYCLE), k=line.rlike(HEADER) & ~line.rlike(r'":\s*$')).where("after = 0 and k > 0").withColumnRenamed("file", "dump")
    g = d.groupBy("dump", "k").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    body = F.transform("l", lambda x: x["line"])
    g = g.select("dump", "k", body[0].alias("h"), F.slice(body, 2, F.size(body)).alias("b"))
    h = lambda i: found(F.col("h"), HEADER, i)
    full = lambda i: F.when(h(i) != "", h(i))
    states = F.filter("b", lambda x: x.rlike(STATE))
    frames = F.transform(F.filter("b", lambda x: x.rlike(FRAME)), lambda x: F.struct(F.regexp_extract(x, FRAME, 2).alias("class_name"), F.regexp_extract(x, FRAME, 3).alias("method"), F.regexp_extract(x, FRAME, 4).alias("file"), F.regexp_extract(x, FRAME, 5).try_cast("int").alias("line")))
    locks = F.transform(F.filter("b", lambda x: x.rlike(LOCK)), lambda x: F.struct(F.regexp_extract(x, LOCK, 1).alias("op"), F.regexp_extract(x, LOCK, 2).alias("address"), F.regexp_extract(x, LOCK, 3).alias("class_name")))
    g = g.withColumns({"frames": frames, "locks": locks, "s": F.get(states, F.lit(0)), "sync": F.transform(F.filter("b", lambda x: x.rlike(SYNC_ITEM)), lambda x: F.regexp_extract(x, SYNC_ITEM, 1))})
    of = lambda *ops: F.transform(F.filter("locks", lambda x: x["op"].isin(*ops)), lambda x: x["address"])
    wanted = F.get(F.filter("locks", lambda x: x["op"] != "locked"), F.lit(0))
    rejected = F.size(F.filter("b", lambda x: x.rlike(r"^\s*at\s") & ~x.rlike(FRAME)))
    return g.select(
        "dump", F.regexp_replace(h(1), r"\\(.)", "$1").alias("name"), full(2).cast("int").alias("id"), full(7).alias("tid"), full(8).alias("nid"), (full(3) == "daemon").isNotNull().alias("daemon"), full(4).cast("int").alias("priority"),
        F.coalesce(found(F.col("s"), STATE, 1), _hint(F.coalesce(h(9), F.lit("")))).alias("state"), F.when(F.regexp_extract("s", STATE, 2) != "", F.regexp_extract("s", STATE, 2)).alias("state_detail"), full(5).cast("double").alias("cpu_ms"), full(6).cast("double").alias("elapsed_s"),
        F.transform("frames", lambda f: F.concat(f["class_name"], F.lit("."), f["method"])).alias("stack"), "frames", "locks",
        F.array_distinct(F.concat(F.array_except(of("locked"), of("waiting on")), F.col("sync"))).alias("held"), F.when(wanted["op"] != "waiting on", wanted["address"]).alias("waits_for"), rejected.alias("rejected"), F.col("k").alias("ord"),
    )


def reported_deadlocks(lines: DataFrame) -> DataFrame:
    """dump, waiter, address, holder as the JVM itself reports them."""
    line = F.col("line")
    waiter = r'^"([^"]+)":\s*$'
    d = running(counted(lines, after=line.rlike(CYCLE)).where("after > 0"), line.rlike(waiter), "at")
    # a waiter with the lines behind it
    g = d.groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    pairs = F.transform("l", lambda x, i: F.struct(x["line"].alias("line"), F.concat_ws(" ", x["line"], F.get("l", i + 1)["line"]).alias("text")))
    waits = F.filter(pairs, lambda x: x["line"].rlike(r"^\s*waiting (?:to lock|for)"))
    d = g.select(F.col("file").alias("dump"), found(F.col("l")[0]["line"], waiter, 1).alias("waiter"), F.explode(waits).alias("w"))
    return d.select("dump", "waiter", found(F.col("w.text"), r"waiting (?:to lock|for) (?:monitor )?(\S+)", 1).alias("address"), found(F.col("w.text"), r'which is held by "([^"]+)"', 1).alias("holder"))
