"""Pairwise comparison of the flows of two references through log lines."""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.functions import text as T
from emberlens.session import cut_lineage, ship_package

# fixed values: keys of fields that may name the same flow
LINK_KEY = r"(?i)((trace|span|correlation|request|txn|transaction|session|order|payment|invoice|job|batch).{0,4}id$|^id$)"
MAX_LINKS, MIN_LINK = 3, 6


def token(line: Column, ref: str) -> Column:
    """Whether a line holds the reference as a whole token."""
    if not ref or re.search(r"\s", ref):
        raise ValueError(f"a reference is one token: {ref!r}")
    return line.rlike("(?<![0-9A-Za-z_-])" + re.escape(ref) + "(?![0-9A-Za-z_-])")


def scan(lines: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Steps (bucket, file, line_no, line, continuations) of each bucket: lines with one of its ids, the
    first bucket winning; stack frames and indented lines behind a hit belong to it until another line."""
    line = F.col("line")
    hit = F.lit(None).cast("string")
    for bucket, ids in reversed(list(wanted.items())):
        fits = F.lit(False)
        for ref in ids:
            fits |= token(line, ref)
        hit = F.when(fits, bucket).otherwise(hit)
    w = Window.partitionBy("file").orderBy("line_no")
    tail = T.is_stack(line) | line.rlike(r"^[ \t]")
    d = lines.withColumn("hit", hit)
    mark = F.when(F.col("hit").isNotNull(), F.col("line_no")).when(~tail & ~line.rlike(r"^\s*$"), F.lit(-1))
    d = d.withColumn("owner", F.last(mark, ignorenulls=True).over(w)).where("owner > 0")
    g = d.groupBy("file", "owner").agg(F.max("hit").alias("bucket"), F.max(F.when(F.col("hit").isNotNull(), F.col("line"))).alias("line"), F.sort_array(F.collect_list(F.when(F.col("hit").isNull() & tail, F.struct("line_no", "line")))).alias("rest"))
    return g.select("bucket", "file", F.col("owner").alias("line_no"), "line", F.transform("rest", lambda x: x["line"]).alias("continuations"))


def links(steps: DataFrame, exclude: list[str]) -> DataFrame:
    """bucket, key, value: the first ids beside the reference that name the same flow, none shared by flows."""
    p = steps.select("bucket", "file", "line_no", F.posexplode(F.map_entries(T.payload(F.col("line"), lambda k: F.lower(k).endswith("id") & k.rlike(LINK_KEY)))).alias("at", "e"))
    p = p.select("bucket", "file", "line_no", "at", F.col("e.key").alias("key"), F.trim("e.value").alias("value")).where(F.col("key").rlike(LINK_KEY) & (F.length("value") >= MIN_LINK) & ~F.contains("value", F.lit(" ")) & ~F.col("value").isin(exclude))
    first = p.groupBy("bucket", "key").agg(F.min_by("value", F.struct("file", "line_no", "at")).alias("value"), F.min(F.struct("file", "line_no", "at")).alias("seen"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("seen"))).where(F.col("k") <= MAX_LINKS)
    own = first.withColumn("n", F.size(F.collect_set("bucket").over(Window.partitionBy("value"))))
    return own.where("n = 1").select("bucket", "key", "value")


def flow_steps(lines: DataFrame, good: str, bad: str, follow_links: bool = True, pair: Column | None = None) -> DataFrame:
    """Steps of both flows in time order: pair, bucket, seq, key, ts_ms, line, payload, is_error. pair parts
    the lines into runs that are compared each for itself, as by file; there is one without it."""
    if good == bad:
        raise ValueError("the two references are one")
    wanted = {"good": [good], "bad": [bad]}
    steps = scan(lines, wanted)
    if follow_links:
        found = links(steps, [good, bad]).collect()  # at most MAX_LINKS for each flow
        for r in found:
            wanted[r.bucket].append(r.value)
        steps = scan(lines, wanted)
    line = F.col("line")
    run = F.lit("1") if pair is None else pair.cast("string")
    order = Window.partitionBy("pair", "bucket").orderBy(F.col("ts_ms").isNull(), "ts_ms", "file", "line_no")
    d = steps.select(run.alias("pair"), "bucket", "file", "line_no", "line", "continuations", F.unix_millis(T.parse_ts(line)).alias("ts_ms"))
    d = d.withColumn("seq", F.row_number().over(order) - 1)
    # behind the window, so that only the columns and steps that are asked for are made
    return d.select("pair", "bucket", "file", "line_no", "line", "ts_ms", F.coalesce(T.call_site(line), T.template(line, (good, bad))).alias("key"), T.significant_payload(line).alias("payload"), (T.is_error(line) | T.has_stack("continuations")).alias("is_error"), "seq")


def _align(t: pa.Table) -> pa.Table:
    """Opcodes of one pair as rows; the matcher needs both sequences whole."""
    rows = sorted(zip(t["bucket"].to_pylist(), t["seq"].to_pylist(), t["key"].to_pylist(), strict=True))
    a, b = ([k for s, _, k in rows if s == side] for side in ("good", "bad"))
    out: list[tuple] = []
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [("SAME", i, j, a[i]) for i, j in zip(range(i1, i2), range(j1, j2), strict=True)]
        else:
            out += [("ONLY_IN_GOOD", i, None, a[i]) for i in range(i1, i2)] + [("ONLY_IN_BAD", None, j, b[j]) for j in range(j1, j2)]
    kind, i, j, key = zip(*out, strict=True) if out else ((),) * 4
    pair = t["pair"][0].as_py()
    return pa.table({"pair": pa.array([pair] * len(out), pa.string()), "idx": pa.array(range(len(out)), pa.int32()), "kind": pa.array(kind, pa.string()), "good_seq": pa.array(i, pa.int32()), "bad_seq": pa.array(j, pa.int32()), "key": pa.array(key, pa.string())})


def align(steps: DataFrame) -> DataFrame:
    """pair, idx, kind, good_seq, bad_seq, key. steps: (pair, bucket good or bad, seq, key)."""
    ship_package(steps.sparkSession)
    return steps.select("pair", "bucket", "seq", "key").groupBy("pair").applyInArrow(lambda t: _align(t), "pair string, idx int, kind string, good_seq int, bad_seq int, key string")


def field_diffs(good: Column, bad: Column, skip: list[str]) -> Column:
    """array<struct<key, good, bad, kind>> of what differs between two payloads."""
    keys = F.array_sort(F.array_union(F.map_keys(good), F.map_keys(bad)))
    g, b = lambda k: F.try_element_at(good, k), lambda k: F.try_element_at(bad, k)
    kind = lambda k: F.when(b(k).isNull(), "MISSING_IN_BAD").when(g(k).isNull(), "EXTRA_IN_BAD").otherwise("VALUE_DIFFERS")
    differs = F.filter(keys, lambda k: ~g(k).eqNullSafe(b(k)) & ~F.coalesce(g(k).isin(skip) & b(k).isin(skip), F.lit(False)))
    return F.transform(differs, lambda k: F.struct(k.alias("key"), g(k).alias("good"), b(k).alias("bad"), kind(k).alias("kind")))


def compare_flows(steps: DataFrame, good: str, bad: str) -> DataFrame:
    """Aligned steps of the two flows of each pair with the field differences of equal steps, in order."""
    a = align(steps)
    side = lambda s: steps.where(F.col("bucket") == s).select("pair", F.col("seq").alias(f"{s}_seq"), F.col("payload").alias(f"{s}_payload"), F.col("is_error").alias(f"{s}_error"))
    d = a.join(side("good"), ["pair", "good_seq"], "left").join(side("bad"), ["pair", "bad_seq"], "left")
    diffs = F.when(F.col("kind") == "SAME", field_diffs(F.col("good_payload"), F.col("bad_payload"), [good, bad]))
    return d.select("pair", "idx", "kind", "key", "good_seq", "bad_seq", diffs.alias("fields"), F.coalesce("bad_error", F.lit(False)).alias("bad_error"), F.coalesce("good_error", F.lit(False)).alias("good_error"))


def break_index(compared: DataFrame) -> DataFrame:
    """pair, break_index: the first step that isn't the same in both flows, null where there is none."""
    differs = (F.col("kind") != "SAME") | (F.size("fields") > 0)
    return compared.groupBy("pair").agg(F.min(F.when(differs, F.col("idx"))).alias("break_index"))


def errors_only_in_bad(steps: DataFrame) -> DataFrame:
    """pair, seq, key, line of the errors of bad flows whose key no error of the good one has."""
    e = cut_lineage(steps.where("is_error").select("pair", "bucket", "seq", "key", F.when(F.col("bucket") == "bad", F.col("line")).alias("line")))
    good = e.where("bucket = 'good'").select("pair", "key").distinct()
    return e.where("bucket = 'bad'").join(good, ["pair", "key"], "left_anti").select("pair", "seq", "key", "line")
