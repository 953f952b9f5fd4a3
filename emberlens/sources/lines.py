"""Numbered lines of text files, ordered files, and records assembled from lines.

Files are split as Spark splits them. Lines are numbered within each split and shifted by the number
of lines in the splits before it; records likewise, so that no window spans a file, let alone all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlens.functions import text as T

FIRST_LINES = 5_000
#: Lines of a file that one window holds.
BLOCK = 65_536


#: Endings of files whose bytes aren't those of their lines.
COMPRESSED = r"(?i)\.(?:gz|bz2|deflate|zst|snappy|lz4|xz)$"


def read_lines(spark: SparkSession, path: str, glob: str | None = None, with_bytes: bool = False) -> DataFrame:
    """file, line_no (from 1), line of all text files below a path, compressed ones included.

    with_bytes adds byte_start and byte_end (exclusive, the line feed included), which give back the line from its
    file; of a compressed file they are places in the expanded text. A mark of the byte order is no part of a line.
    """
    r = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    d = (r.option("pathGlobFilter", glob) if glob else r).text(path)
    sizes = [F.col("_metadata.file_size").alias("size"), (F.octet_length("value") + F.lit(1).cast("bigint")).alias("octets")] if with_bytes else []
    d = d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"), *sizes)
    in_block = Window.partitionBy("file", "block").orderBy("at")
    over = {"n": F.count("*"), **({"octets": F.sum("octets"), "size": F.max("size")} if with_bytes else {})}
    blocks = d.groupBy("file", "block").agg(*[c.alias(k) for k, c in over.items()])
    # a row for each block of a file
    before, whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    sums = [F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")]
    if with_bytes:
        plain = ~F.col("file").rlike(COMPRESSED)
        # lines were counted with a feed each, which the last may lack; what is left beside it is the mark
        extra = F.when(plain & (F.max("size").over(whole) - F.sum("octets").over(whole) >= 2), 3).otherwise(0)
        sums += [F.coalesce(F.sum("octets").over(before), F.lit(0)).alias("octets_ahead"), extra.alias("mark"), F.when(plain, F.max("size").over(whole)).alias("end")]
    ahead = blocks.select("file", "block", *sums)
    d = d.drop("size").withColumn("k", F.row_number().over(in_block))
    if with_bytes:
        d = d.withColumn("upto", F.sum("octets").over(in_block))
    d = d.join(ahead, ["file", "block"])
    stop = F.col("octets_ahead") + F.col("upto") + F.col("mark")
    places = [(stop - F.col("octets")).alias("byte_start"), F.least(stop, F.col("end")).alias("byte_end")] if with_bytes else []
    return d.select("file", (F.col("k") + F.col("ahead")).alias("line_no"), "line", *places)


def running(lines: DataFrame, start: Column, out: str, count: bool = False) -> DataFrame:
    """lines with the place of the last starting line of their file at or before each, 0 before the first;
    or with the number of starting lines so far. Within blocks of BLOCK lines and over the blocks of a
    file, so that no window spans a file."""
    return _folded(lines, {out: start}, count)


def counted(lines: DataFrame, **starts: Column) -> DataFrame:
    """lines with the numbers of several kinds of starting lines so far, in one pass."""
    return _folded(lines, starts, True)


def _folded(lines: DataFrame, starts: dict[str, Column], count: bool) -> DataFrame:
    value = lambda c: F.when(F.coalesce(c, F.lit(False)), F.lit(1).cast("bigint") if count else F.col("line_no"))
    d = lines.withColumns({"_b": F.floor(F.col("line_no") / BLOCK), **{f"_s_{out}": value(c) for out, c in starts.items()}})
    fold = F.sum if count else F.max
    ahead = d.groupBy("file", "_b").agg(*[fold(f"_s_{out}").alias(f"_n_{out}") for out in starts])
    earlier = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select("file", "_b", *[F.coalesce(fold(f"_n_{out}").over(earlier), F.lit(0)).alias(f"_ahead_{out}") for out in starts])
    inside = Window.partitionBy("file", "_b").orderBy("line_no")
    d = d.withColumns({f"_own_{out}": F.coalesce(fold(f"_s_{out}").over(inside), F.lit(0)) for out in starts}).join(ahead, ["file", "_b"])
    both = lambda out: F.col(f"_own_{out}") + F.col(f"_ahead_{out}") if count else F.greatest(f"_own_{out}", f"_ahead_{out}")
    return d.withColumns({out: both(out) for out in starts}).drop("_b", *[f"{x}_{out}" for x in ("_s", "_own", "_ahead") for out in starts])


def file_order(lines: DataFrame) -> DataFrame:
    """file, file_rank: by the first timestamp within the first lines, files without one last, then path."""
    ts = T.parse_ts(F.col("line"))
    f = lines.where(F.col("line_no") <= FIRST_LINES).withColumn("ts", ts).groupBy("file").agg(F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).alias("first_ts"))
    # one row for each file
    return f.select("file", "first_ts", F.row_number().over(Window.orderBy(F.col("first_ts").isNull(), "first_ts", "file")).alias("file_rank"))


def assemble(lines: DataFrame, order: DataFrame, starts: Column) -> DataFrame:
    """Lines with rec_id: a record is a starting line with all lines up to the next start, in the order
    of the files, open records going on in the next file. Lines before any start have rec_id 0."""
    d = running(lines.join(order.select("file", "file_rank"), "file"), starts, "own", count=True)
    per_file = lines.groupBy("file").agg(F.count_if(F.coalesce(starts, F.lit(False))).alias("n")).join(order.select("file", "file_rank"), "file")
    # one row for each file
    ahead = per_file.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return d.join(ahead, "file").withColumn("rec_id", F.col("own") + F.col("ahead")).drop("own", "ahead")


def record_columns(line: Column, rest: Column) -> list[Column]:
    """What a record's first line and the array of those behind it tell."""
    return [
        T.thread(line).alias("thread_id"),
        F.unix_millis(T.parse_ts(line)).alias("ts_ms"),
        F.coalesce(T.call_site(line), T.template(line)).alias("call_site"),
        T.level(line).alias("level"),
        line.alias("message"),
        T.has_stack(rest).alias("has_stack"),
    ]


def read_records(lines: DataFrame) -> DataFrame:
    """Best-effort records of any log layout, in the shape that segmentation takes: thread_id, ts_ms,
    call_site (else the template of the line), level, message, has_stack, o1, o2, file."""
    line = F.col("line")
    d = assemble(lines, file_order(lines), ~T.is_continuation(line)).where("rec_id > 0")
    head = F.row_number().over(Window.partitionBy("rec_id").orderBy("file_rank", "line_no")) == 1
    r = d.withColumn("head", head).groupBy("rec_id").agg(
        F.min_by("line", ~F.col("head")).alias("line"),
        F.min_by(F.struct("file", "file_rank", "line_no"), ~F.col("head")).alias("at"),
        F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("file_rank", "line_no", "line")))).alias("rest"),
    )
    at = [F.col("at.file_rank").cast("bigint").alias("o1"), F.col("at.line_no").cast("bigint").alias("o2"), F.col("at.file").alias("file")]
    return r.select(*record_columns(line, F.transform("rest", lambda x: x["line"])), *at, F.size("rest").alias("n_continuations"))


def read_profile(lines: DataFrame, pattern_ok: Column | None = None) -> DataFrame:
    """Records of pipe-delimited logs: lines that don't fit continue the last that did; those before the
    first that fits are malformed and go."""
    e = T.envelope(F.col("line"))
    d = assemble(lines, file_order(lines), e.isNotNull()).where("rec_id > 0").withColumn("e", e).where("e is not null")
    return d.select(F.col("e.thread").alias("thread_id"), F.unix_millis(T.parse_ts(F.col("e.ts"))).alias("ts_ms"), F.concat_ws(":", "e.class_name", F.col("e.line_number").cast("string")).alias("call_site"), T.level(F.col("e.level")).alias("level"), F.col("e.message").alias("message"), F.lit(False).alias("has_stack"), F.col("file_rank").cast("bigint").alias("o1"), F.col("line_no").cast("bigint").alias("o2"), "file")


def parse_stats(lines: DataFrame) -> DataFrame:
    """One row: lines, records, continuations, records without timestamp and without call site."""
    c, line = T.is_continuation(F.col("line")), F.col("line")
    return lines.agg(F.count("*").alias("lines"), F.count_if(~c).alias("records"), F.count_if(c).alias("continuations"), F.count_if(~c & T.parse_ts(line).isNull()).alias("without_ts"), F.count_if(~c & T.call_site(line).isNull()).alias("without_call_site"))


def match_rate(lines: DataFrame, first: int = 10_000, least: float = 0.0) -> DataFrame:
    """One row: matched and malformed among the first lines of the corpus, and their rate; below the least
    rate the log isn't of this layout, an error."""
    d = lines.where(F.col("line_no") <= first)
    line = F.col("line")
    g = d.agg(F.count_if(T.envelope(line).isNotNull()).alias("matched"), F.count_if(T.envelope(line).isNull() & ~T.is_continuation(line) & ~line.rlike(r"^\s*$")).alias("malformed"))
    g = g.withColumn("rate", F.coalesce(F.try_divide("matched", F.col("matched") + F.col("malformed")), F.lit(0.0)))
    if least > 0 and (r := g.first()).rate < least:
        raise ValueError(f"only {r.rate:.1%} of the sampled lines match; {least:.1%} are asked for")
    return g


# fixed values: timestamp layouts that are tried, in order
LAYOUTS = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss,SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss,SSS", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "HH:mm:ss.SSS")


def detect_format(lines: DataFrame, sample: int = 500) -> dict[str, object] | None:
    """Number of pipe-delimited fields and timestamp layout of a sample, or None if it isn't such a log:
    half of the lines have a pipe, and one layout reads nine of ten first fields."""
    s = lines.where(~F.col("line").rlike(r"^\s*$")).orderBy("file", "line_no").limit(sample)
    first = F.trim(F.substring_index("line", "|", 1))
    piped = F.col("line").contains("|")
    n_fields = F.least(F.size(F.split("line", r"\|")), F.lit(5))
    r = s.agg(F.count("*").alias("n"), F.count_if(piped).alias("piped"), F.mode(F.when(piped, n_fields)).alias("fields"), *[F.count_if(piped & F.try_to_timestamp(first, F.lit(x)).isNotNull()).alias(f"l{i}") for i, x in enumerate(LAYOUTS)]).first()
    if not r.n or r.piped * 2 < r.n:
        return None
    good = [x for i, x in enumerate(LAYOUTS) if r[f"l{i}"] >= 0.9 * r.piped]
    return {"fields": r.fields, "timestamp": good[0]} if good else None
