"""Extraction from log lines as column expressions.

All patterns carry (?U), so that word characters, digits and boundaries are those of Unicode.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the shapes of timestamps, in the order in which they are tried
TS_FRACTION = r"(?U)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]\d{1,9}"
TS_SECONDS = r"(?U)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
TS_SLASHES = r"(?U)\d{2}/\d{2}/\d{4}[T ]\d{2}:\d{2}:\d{2}"
TS_CLOCK = r"(?U)\d{2}:\d{2}:\d{2}[.,]\d{1,3}"
TIMESTAMPS = (TS_FRACTION, TS_SECONDS, TS_SLASHES, TS_CLOCK)
# fixed values: fields of a line
CALL_SITE = r"(?U)\b([A-Za-z_][A-Za-z0-9_.$]*+):(\d{1,6})\b"
LEVEL = r"(?U)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|SEVERE)\b"
THREAD_BRACKET = r"(?U)\[([A-Za-z][\w.\-]{1,60})\]"
THREAD_KV = r"""(?U)\bthread(?:[Nn]ame)?\s*[=:]\s*"?([\w.\-]+)"?"""
THREAD_STYLE = r"(?U)\b((?:http-[\w.\-]*exec-\d+|pool-\d+-thread-\d+|[\w.\-]*exec(?:utor)?-\d+|Thread-\d+|main))\b"
STACK = r"(?U)^\s*(at\s+\S+\(|Caused by:|\.\.\.\s*\d+\s+more|[\w.$]+(Exception|Error)\b)"
ERROR_WORD = r"(?Ui)\b(ERROR|FATAL|SEVERE|Exception|failed|failure)\b"
VALUE = r"""("[^"]*"|\{[^}]*\}|\[[^\]]*\]|[^\s,;}\])]+)"""
# a key is tried from its first letter alone and isn't given back: neither could end in another match
KV = r'(?U)"?(?<![A-Za-z_])([A-Za-z_][A-Za-z0-9_.]*+)"?+\s*+[=:]\s*+' + VALUE
NOISE_KEYS = (
    "trace_id", "traceid", "span_id", "spanid", "correlationid", "correlation_id", "requestid", "request_id", "reqid", "orderid", "order_id", "paymentid", "payment_id", "id", "timestamp", "ts", "time", "date",
)


def found(line: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null without one."""
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, group))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def first(line: Column, pattern: str, group: int) -> Column:
    """``found`` in one pass, for groups that are never empty where the pattern fits."""
    return once(F.regexp_extract(line, pattern, group), lambda x: F.when(x != "", x))


def parse_ts(line: Column) -> Column:
    """The first timestamp of a line as a UTC timestamp, null if none is valid.

    A fraction of more than six digits isn't understood, and the time is cut to seconds; an offset is
    ignored; a time of day falls on 1900-01-01.
    """
    full = F.regexp_replace(F.regexp_replace(found(line, TS_FRACTION), ",", "."), "T", " ")
    micros = F.when(F.char_length(F.substring_index(full, ".", -1)) <= 6, F.try_to_timestamp(full, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]")))
    seconds = F.try_to_timestamp(F.regexp_replace(found(line, TS_SECONDS), "T", " "), F.lit("yyyy-MM-dd HH:mm:ss"))
    slashes = F.try_to_timestamp(found(line, TS_SLASHES), F.lit("dd/MM/yyyy HH:mm:ss"))
    clock = F.concat(F.lit("1900-01-01 "), F.regexp_replace(found(line, TS_CLOCK), ",", "."))
    clock = F.try_to_timestamp(clock, F.lit("yyyy-MM-dd HH:mm:ss[.SSS][.SS][.S]"))
    return F.coalesce(micros, seconds, slashes, clock)


def strip_ts(line: Column) -> Column:
    for p in TIMESTAMPS:
        line = F.regexp_replace(line, p, " ")
    return line


def call_site(line: Column) -> Column:
    return first(line, CALL_SITE, 0)


def level(line: Column) -> Column:
    word = found(line, LEVEL, 1)
    return F.when(word == "WARNING", "WARN").otherwise(word)


def thread(line: Column) -> Column:
    tokens = F.regexp_extract_all(line, F.lit(THREAD_BRACKET), F.lit(1))
    other = F.get(F.filter(tokens, lambda t: ~t.rlike("^(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|SEVERE)$")), F.lit(0))
    return F.coalesce(found(line, THREAD_KV, 1), found(line, THREAD_STYLE, 1), other)


def is_stack(line: Column) -> Column:
    return line.rlike(STACK)


def is_error(line: Column) -> Column:
    return line.rlike(ERROR_WORD)


def is_continuation(line: Column) -> Column:
    """Not blank, without a timestamp, and a stack frame or indented."""
    return ~line.rlike(r"(?U)^\s*$") & parse_ts(line).isNull() & (is_stack(line) | line.rlike(r"^[ \t]"))


def _pairs(text: Column) -> Column:
    """array<struct<key, value>> of all pairs, a value in braces giving its own pairs."""
    both = lambda t: F.arrays_zip(F.regexp_extract_all(t, F.lit(KV), F.lit(1)).alias("k"), F.regexp_extract_all(t, F.lit(KV), F.lit(2)).alias("v"))
    bare = lambda p: F.struct(p["k"].alias("k"), F.trim(p["v"]).alias("v"))
    nested = lambda p: F.transform(both(F.substring(p["v"], F.lit(2), F.char_length(p["v"]) - 2)), bare)
    every = lambda t: F.flatten(F.transform(both(t), lambda p: F.when(p["v"].startswith("{") & p["v"].endswith("}"), nested(p)).otherwise(F.array(bare(p)))))
    return once(text, every)


def payload(text: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """All pairs, or those whose key is to be kept, as a map without quotes, later keys before earlier ones."""
    found = _pairs(strip_ts(F.coalesce(text, F.lit(""))))
    if keep is not None:
        found = F.filter(found, lambda p: keep(p["k"]))
    pairs = F.transform(found, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), F.trim(p["v"], F.lit('"')).alias("v")))
    # by key and place, so that the last of a key stands before another key; bound to a variable, which a lambda
    # function would otherwise compute for every element anew
    last = lambda ps: F.filter(ps, lambda p, i: ~F.coalesce(F.get(ps, i + 1)["k"] == p["k"], F.lit(False)))
    entries = lambda ps: F.transform(last(ps), lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    return F.transform(F.array(F.sort_array(pairs)), lambda ps: F.map_from_entries(entries(ps)))[0]


def significant_payload(text: Column) -> Column:
    return F.map_filter(payload(text), lambda k, _: ~F.lower(k).isin(*NOISE_KEYS))


def template(line: Column, refs: Sequence[str] = ()) -> Column:
    """What lines of one log statement have in common: everything that varies is masked."""
    t = strip_ts(line)
    for r in refs:
        if r:
            t = F.replace(t, F.lit(r), F.lit(" "))
    t = F.regexp_replace(t, LEVEL, " ")
    t = F.regexp_replace(t, r'(?U)("[A-Za-z_][A-Za-z0-9_.]*"\s*:\s*)' + VALUE, "$1?")
    t = F.regexp_replace(t, r"(?U)(\b[A-Za-z_][A-Za-z0-9_.]*+\s*+=\s*+)" + VALUE, "$1?")
    t = F.regexp_replace(t, r"(?U)\b[0-9a-fA-F]{8,}\b", "?")
    t = F.regexp_replace(t, r"(?U)\b\d+\b", "?")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "), F.lit(" |\t-"))


def has_stack(continuations: Column) -> Column:
    """Whether any continuation line is part of a stack trace."""
    return F.exists(continuations, lambda c: F.ltrim(c).startswith("at ") | F.ltrim(c).startswith("Caused by:") | F.ltrim(c).startswith("... ") | c.contains("Exception") | c.contains("Error:"))


def envelope(line: Column) -> Column:
    """struct<ts, level, thread, class_name, line_number, message> of a pipe-delimited line, null if it
    isn't one. The message is the rest of the line, separators and all."""
    p = r"(?U)^(\S+ \S+)\s*\|\s*(\w+)\s*\|\s*([^|]+?)\s*\|\s*([^:|]+):(\d+)\s*\|\s*(.*)$"
    g = lambda i: F.regexp_extract(line, p, i)
    return F.when(line.rlike(p), F.struct(g(1).alias("ts"), g(2).alias("level"), g(3).alias("thread"), g(4).alias("class_name"), g(5).cast("int").alias("line_number"), g(6).alias("message")))


def server_level(word: Column) -> Column:
    w = F.upper(word)
    w = F.when(w == "WARNING", "WARN").when(w == "SEVERE", "ERROR").otherwise(w)
    return F.when(w.isin("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"), w).otherwise("UNKNOWN")


def artifact_name(path: Column) -> Column:
    """Base name without a deployment suffix; nothing left is the root application."""
    base = F.regexp_replace(F.substring_index(F.regexp_replace(F.regexp_replace(path, r"[\\]", "/"), "/+$", ""), "/", -1), r"(?i)\.(war|ear|jar|xml)$", "")
    return F.when(base == "", "ROOT").otherwise(base)


def thread_norm(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)\d+", "#")


def stack_signature(frames: Column) -> Column:
    """Twelve hex digits of the top five Class.method frames."""
    return F.substring(F.sha1(F.array_join(F.slice(frames, 1, 5), "|")), 1, 12)


def class_name(descriptor: Column) -> Column:
    """Dotted name with [] of a JVM type descriptor or slashed name."""
    dims = F.char_length(F.regexp_extract(descriptor, r"^\[*", 0))
    core = F.regexp_replace(descriptor, r"^\[+", "")
    prim = F.create_map(*[F.lit(x) for kv in {"Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double"}.items() for x in kv])
    obj = F.regexp_replace(F.regexp_replace(core, "^L(.*);$", "$1"), "/", ".")
    name = F.when((dims > 0) & (F.char_length(core) == 1), F.coalesce(F.element_at(prim, core), core)).otherwise(obj)
    return F.concat(name, F.repeat(F.lit("[]"), dims))


def outer_class(name: Column) -> Column:
    return F.substring_index(F.regexp_replace(name, r"(\[\])+$", ""), "$", 1)


def simple_class(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def package_of(name: Column) -> Column:
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("(default)")


# fixed values: name prefixes of the platform and common frameworks
PLATFORM = (
    "java.", "javax.", "jdk.", "sun.", "com.sun.", "kotlin.", "kotlinx.", "scala.", "org.springframework.", "org.hibernate.", "org.apache.", "io.netty.", "io.micrometer.", "io.opentelemetry.", "ch.qos.logback.", "org.slf4j.", "org.jboss.", "com.zaxxer.hikari.", "reactor.", "rx.", "io.reactivex.", "feign.", "okhttp3.", "retrofit2.", "com.fasterxml.", "com.google.",
)
PRIMITIVES = ("boolean", "byte", "char", "short", "int", "long", "float", "double", "void")


def is_user_code(name: Column) -> Column:
    base = F.regexp_replace(name, r"(\[\])+$", "")
    known = "^(" + "|".join(p.replace(".", r"\.") for p in PLATFORM) + ")"
    return (base != "") & ~base.isin(*PRIMITIVES) & ~base.rlike(known)


def shallow_size(payload_bytes: Column, refs: Column, length: Column | None = None, width: Column | None = None, id_size: int = 8, compressed: bool = True) -> Column:
    """Bytes of an instance (payload with ids of id_size) or, given length and element width, of an
    array, under the usual object layout."""
    header, array_header, oop = (8, 12, 4) if id_size == 4 else (12, 16, 4) if compressed else (16, 24, 8)
    size = header + payload_bytes - (id_size - oop) * refs if length is None else array_header + length * width
    return F.floor((size + 7) / 8) * 8


def evidence_id(category: Column, title: Column, evidence: Column) -> Column:
    return F.concat(F.lit("E-"), F.substring(F.sha2(F.concat_ws("|", category, title, F.array_join(evidence, "|")), 256), 1, 12))


# fixed values: units of sizes in megabytes, and the shape of a size change
UNITS = {"B": 1 / 1024 / 1024, "K": 1 / 1024, "M": 1.0, "G": 1024.0}
GC_SIZES = r"(\d+(?:\.\d+)?)([BKMG])->(\d+(?:\.\d+)?)([BKMG])\((\d+(?:\.\d+)?)([BKMG])\)"


def gc_megabytes(number: Column, unit: Column) -> Column:
    scale = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit)
    return number.cast("double") * scale


def gc_fields(line: Column) -> Column:
    """struct<gc_id, before_mb, after_mb, total_mb, pause_ms, head>; sizes are null where the line has
    none, head is the text before them. The pause stands behind the sizes where there are any; what
    stands before them may be the uptime."""
    has = line.rlike(GC_SIZES)
    size = lambda i: F.when(has, gc_megabytes(F.regexp_extract(line, GC_SIZES, i), F.regexp_extract(line, GC_SIZES, i + 1)))
    ms, secs = r"(\d+(?:\.\d+)?)\s*ms\b", r",\s*(\d+(?:\.\d+)?)\s*secs\b"
    parts = F.split(line, GC_SIZES, 2)
    tail = F.when(has, F.get(parts, F.lit(1))).otherwise(line)
    pause = F.when(tail.rlike(ms), F.regexp_extract(tail, ms, 1).cast("double")).when(line.rlike(secs), F.regexp_extract(line, secs, 1).cast("double") * 1000)
    gc_id = F.when(line.rlike(r"GC\((\d+)\)"), F.regexp_extract(line, r"GC\((\d+)\)", 1).cast("int"))
    head = F.when(has, F.get(parts, F.lit(0))).otherwise(line)
    return F.struct(gc_id.alias("gc_id"), size(1).alias("before_mb"), size(3).alias("after_mb"), size(5).alias("total_mb"), pause.alias("pause_ms"), head.alias("head"))


def bucket(n: Column, bounds: Sequence[float]) -> Column:
    """Label of the first bound that n doesn't exceed, bounds inclusive."""
    c = F.lit(f">{bounds[-1]}")
    for b in reversed(bounds):
        c = F.when(n <= b, f"<={b}").otherwise(c)
    return c
