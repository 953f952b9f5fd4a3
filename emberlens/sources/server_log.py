"""Server-log events assembled from numbered lines: headers, exceptions, frames, identifiers, markers.

A line with a header, in text or as JSON, begins an event; others belong to it. An event that reaches
MAX_LINES lines is truncated, and the lines behind it are events without a header; of one event at most
MAX_FRAMES frames and MAX_CHARS characters of text are kept, of one line LINE_CHARS. What is cut is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.functions import text as T
from emberlens.sources.lines import running

MAX_LINES, MAX_FRAMES, MAX_MARKERS, MAX_CHARS, LINE_CHARS = 256, 128, 8, 32_768, 65_536
# fixed values: shapes of frames, exceptions, markers and identifiers
FRAME = r"^\s*at\s+(?:[^\s(]*/)?([\w$]+(?:\.[\w$]+)*)\.([\w$<>]+)\(([^():]+)(?::(\d+))?\)"
EXCEPTION = r"(?<![\w.])((?:[\w$]+\.)*[\w$]*(?:Exception|Error|Throwable))\b"
ARTIFACT = r'["\[]?([^\s"\]]+)'
MARKERS = (
    ("oom", r"java\.lang\.OutOfMemoryError(?::\s*([^\r\n]{1,200}))?"),
    ("deploy", r"Deploying (?:web application (?:archive|directory)|configuration descriptor) " + ARTIFACT),
    ("undeploy", r"Undeploying context " + ARTIFACT),
    ("deploy", r"Reloading Context with name " + ARTIFACT),
    ("server_start", r"Server startup in \[?(\d+)\]? ?(?:ms|milliseconds)"),
    ("deploy", r'WFLYSRV0010: Deployed "([^"]+)"'),
    ("undeploy", r'WFLYSRV0009: Undeployed "([^"]+)"'),
    ("server_start", r"WFLYSRV0025: (.{1,120}?) started"),
    ("heap_dump", r"Dumping heap to (\S+)"),
    ("server_start", r"Started ([\w$.]+) in [\d.]+ seconds"),
)
TRACE_ID = r"""(?i)\b(?:trace[_-]?id|traceId)\s*[=:]\s*["']?([\w.-]{1,128})"""
REQUEST_ID = r"""(?i)\b(?:request[_-]?id|requestId|correlation[_-]?id)\s*[=:]\s*["']?([\w.-]{1,128})"""
JSON_KEYS = {
    "level": ("level", "log.level", "severity"), "raw_timestamp": ("@timestamp", "timestamp", "time", "date"), "thread": ("thread_name", "thread", "threadName"), "logger": ("logger_name", "logger", "loggerName"),
    "trace_id": ("trace_id", "traceId", "trace.id"), "request_id": ("request_id", "requestId", "correlationId"), "message": ("message", "msg", "formattedMessage"), "stack": ("stack_trace", "stacktrace", "exception"),
}
NO_HEADER = r"^\s*(?:at |Caused by:|Suppressed:|\.\.\. )"
BRACKETED, PARENTHESISED = r"\[([^\]\r\n]{1,256})\]", r"\(([^)\r\n]{1,256})\)"
LOGGER = r"(?<![\w.])([\w$]+(?:\.[\w$]+)+)\s*(?:\s+-|\s*:|\])"
ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"


def is_json(line: Column) -> Column:
    """A whole JSON object."""
    return F.ltrim(line).startswith("{") & F.get_json_object(line, "$").isNotNull()


def json_field(line: Column, name: str) -> Column:
    return F.coalesce(*[F.get_json_object(line, f"$['{k}']") for k in JSON_KEYS[name]])


def timestamp(raw: Column, zone: str | None = None) -> Column:
    """UTC at milliseconds; without an offset only if the caller names one."""
    t = F.regexp_replace(F.regexp_replace(raw, ",", "."), "^(\\d{4}-\\d{2}-\\d{2}) ", "$1T")
    t = F.regexp_replace(F.regexp_replace(t, r"(\.\d{3})\d+", "$1"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    offset = t.rlike(r"(?:Z|[+-]\d{2}:\d{2})$")
    full = F.when(offset, t) if zone is None else F.when(offset, t).otherwise(F.concat(t, F.lit(zone)))
    return F.date_trunc("millisecond", F.try_to_timestamp(full))


def begins_text(line: Column) -> Column:
    """A date in the first 160 characters or a level in the first 512, but not the start of a stack frame."""
    return (F.substring(line, 1, 160).rlike(r"\b" + ISO) | F.substring(line, 1, 512).rlike(T.LEVEL)) & ~line.rlike(NO_HEADER)


def begins(line: Column) -> Column:
    """Whether ``header`` isn't null, without what it tells."""
    return is_json(line) | begins_text(line)


def header(line: Column) -> Column:
    """struct<level, raw_timestamp, thread, logger, message, json> of a starting line, else null: a JSON
    object, or text with a date in its first 160 characters or a level in its first 512.

    The thread is in the first brackets that hold no level or date, or, as some servers put it, in
    parentheses behind the level, where the logger is as well.
    """
    brackets = F.regexp_extract_all(F.substring(line, 1, 1024), F.lit(BRACKETED), F.lit(1))
    plain = F.get(F.filter(brackets, lambda x: ~x.rlike("^(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|SEVERE)$") & ~x.rlike(rf"^{ISO}$")), F.lit(0))

    def of(x: Column) -> Column:
        word, after = x["level"], x["after"]
        thread = F.when(word.isNotNull(), F.coalesce(T.first(F.substring(after, 1, 512), PARENTHESISED, 1), plain))
        return F.struct(word.alias("level"), T.first(F.substring(line, 1, 160), r"\b" + ISO, 0).alias("raw_timestamp"), thread.alias("thread"), T.first(after, LOGGER, 1).alias("logger"), F.rtrim(line).alias("message"), F.lit(False).alias("json"))

    behind = lambda word: F.struct(word.alias("level"), F.when(word.isNotNull(), F.substring(F.get(F.split(line, T.LEVEL, 2), F.lit(1)), 1, 1024)).alias("after"))
    text = F.when(begins_text(line), T.once(T.once(T.first(F.substring(line, 1, 512), T.LEVEL, 1), behind), of))
    j = F.struct(*[json_field(line, k).alias(k) for k in ("level", "raw_timestamp", "thread", "logger")], F.coalesce(json_field(line, "message"), F.lit("")).alias("message"), F.lit(True).alias("json"))
    return F.when(is_json(line), j).otherwise(text)


def all_markers(lines: Column) -> Column:
    """array<struct<kind, detail>> of the lines of an event: the first pattern that fits each, each pair
    once."""
    def one(x: Column) -> Column:
        c = F.lit(None).cast("struct<kind:string,detail:string>")
        for kind, p in reversed(MARKERS):
            detail = F.trim(F.regexp_extract(x, p, 1))
            detail = F.substring(T.artifact_name(detail) if kind in ("deploy", "undeploy") else detail, 1, 200)
            c = F.when(x.rlike(p), F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))).otherwise(c)
        return F.when(~F.ltrim(x).startswith("at "), c)

    return F.array_distinct(F.filter(F.transform(lines, one), lambda m: m.isNotNull()))


def markers_of(lines: Column) -> Column:
    """The first MAX_MARKERS markers of an event."""
    return F.slice(all_markers(lines), 1, MAX_MARKERS)


def frames_of(lines: Column) -> Column:
    f = F.filter(lines, lambda x: x.rlike(FRAME))
    g = lambda x, i: F.regexp_extract(x, FRAME, i)
    return F.slice(F.transform(f, lambda x: F.struct(g(x, 1).alias("class_name"), g(x, 2).alias("method"), g(x, 3).alias("file"), g(x, 4).try_cast("int").alias("line"))), 1, MAX_FRAMES)


def events(lines: DataFrame, zone: str | None = None) -> DataFrame:
    """One row per event of each file: id, lines, level, ts, raw_timestamp, thread, logger, identifiers,
    message, exception (the last named), frames, markers, excerpt, truncated, format, and what was cut or
    replaced: oversized_lines, omitted_frames, omitted_markers, omitted_chars, replacement_characters. Lines with
    places (``read_lines`` with_bytes) give byte_start and byte_end, others null."""
    d = lines if "byte_start" in lines.columns else lines.withColumns({k: F.lit(None).cast("bigint") for k in ("byte_start", "byte_end")})
    d = d.withColumn("cut", F.char_length("line") > LINE_CHARS).withColumn("replaced", F.char_length("line") - F.char_length(F.replace("line", F.lit("\ufffd"), F.lit(""))))
    d = d.withColumn("line", F.substring("line", 1, LINE_CHARS))
    d = running(d, begins(F.col("line")), "k").withColumn("k", F.greatest("k", F.lit(1)))
    d = d.withColumn("part", F.floor((F.col("line_no") - F.col("k")) / MAX_LINES))
    g = d.groupBy("file", "k", "part").agg(
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.min("byte_start").alias("byte_start"),
        F.max("byte_end").alias("byte_end"),
        F.min_by("line", "line_no").alias("first"),
        F.sort_array(F.collect_list(F.struct("line_no", F.substring("line", 1, MAX_CHARS).alias("line")))).alias("l"),
        F.sum(F.greatest(F.char_length("line") - MAX_CHARS, F.lit(0))).alias("cut_chars"),
        F.count_if("cut").alias("oversized_lines"),
        F.sum("replaced").alias("replacement_characters"),
    )
    goes_on = F.lead("part").over(Window.partitionBy("file", "k").orderBy("part")).isNotNull()
    # only the first line of an event can have a header
    g = g.withColumn("full", (F.col("oversized_lines") > 0) | goes_on).withColumn("h", header(F.col("first")))
    g = g.withColumn("cut_chars", F.col("cut_chars") - F.when(F.coalesce("h.json", F.lit(False)), F.greatest(F.char_length("first") - MAX_CHARS, F.lit(0))).otherwise(0))
    raw = F.transform("l", lambda x: x["line"])
    # a JSON event is its message and its stack, not the line that carries them
    inner = F.concat_ws("\n", F.col("h.message"), json_field(raw[0], "stack"))
    g = g.withColumn("body", F.when(F.col("h.json"), F.concat(F.split(inner, "\n"), F.slice(raw, 2, MAX_LINES))).otherwise(raw)).withColumn("head", raw[0])
    text = F.array_join("body", "\n")
    # most lines lack the word, which is looked for before the pattern
    named = F.filter("body", lambda x: (x.contains("Exception") | x.contains("Error") | x.contains("Throwable")) & x.rlike(EXCEPTION))
    ids = lambda name, p: F.coalesce(F.when(F.col("h.json"), json_field(F.col("head"), name)), T.first(text, p, 1))
    beyond = lambda n, most: F.greatest(n - most, F.lit(0)).cast("bigint")
    g = g.withColumn("found", all_markers(F.col("body"))).withColumn("omitted_frames", beyond(F.size(F.filter("body", lambda x: x.rlike(FRAME))), MAX_FRAMES))
    g = g.withColumn("omitted_chars", F.col("cut_chars") + beyond(F.length(text), MAX_CHARS))
    full = F.col("full") | (F.col("omitted_chars") > 0) | (F.col("omitted_frames") > 0)
    return g.select(
        "file", F.col("start_line").alias("id"), "start_line", "end_line", "byte_start", "byte_end", T.server_level(F.coalesce("h.level", F.lit(""))).alias("level"), timestamp(F.col("h.raw_timestamp"), zone).alias("ts"), "h.raw_timestamp", "h.thread", "h.logger",
        ids("trace_id", TRACE_ID).alias("trace_id"), ids("request_id", REQUEST_ID).alias("request_id"), F.coalesce("h.message", F.rtrim("head")).alias("message"), F.when(F.size(named) > 0, F.regexp_extract(F.element_at(named, -1), EXCEPTION, 1)).alias("exception"),
        frames_of(F.col("body")).alias("frames"), F.slice("found", 1, MAX_MARKERS).alias("markers"), F.substring(text, 1, MAX_CHARS).alias("excerpt"), full.alias("truncated"), F.when(F.col("h.json"), "json").when(F.col("h").isNotNull(), "text").otherwise("unrecognized").alias("format"),
        "oversized_lines", "omitted_frames", beyond(F.size("found"), MAX_MARKERS).alias("omitted_markers"), "omitted_chars", "replacement_characters",
    )


def accounts(found: DataFrame) -> DataFrame:
    """One row per file of events: bytes and lines they cover, events, those truncated, without a known level and
    with a time that no offset aligns, and the sums of what was cut or replaced."""
    sums = ("oversized_lines", "omitted_frames", "omitted_markers", "omitted_chars", "replacement_characters")
    return found.groupBy("file").agg(
        F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"),
        F.sum(F.col("end_line") - F.col("start_line") + 1).alias("lines"),
        F.count("*").alias("events"),
        F.count_if("truncated").alias("truncated_events"),
        F.count_if(F.col("level") == "UNKNOWN").alias("unrecognized_events"),
        F.count_if(F.col("raw_timestamp").isNotNull() & F.col("ts").isNull()).alias("unaligned_timestamps"),
        *[F.sum(c).alias(c) for c in sums],
    )
