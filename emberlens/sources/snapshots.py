"""Database snapshots, source trees and artifacts as tables, and tables as reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlens.session import few

SECTIONS = {
    "queries": "query_digest string, normalized_sql string, calls long, total_time_ms double, mean_time_ms double, rows_returned long, rows_examined long, calls_per_day double, time_per_day_ms double",
    "tables": "schema_name string, name string, size_bytes long, row_estimate long, seq_scans long, dead_tuple_ratio double, last_autovacuum string, data_free_bytes long, growth_30d_pct double",
    "indexes": "table string, name string, definition string, size_bytes long, scans long, is_primary boolean, is_unique boolean",
    "sessions": "session_id string, state string, query_digest string, age_seconds double",
    "lock_waits": "blocker_digest string, blocked_digest string, wait_ms double",
    "settings": "name string, value string, unit string",
    "procedures": "schema_name string, name string, definition string, language string",
    "columns": "schema_name string, table string, name string, data_type string",
}
MAX_BYTES = 10 * 1024 * 1024


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Section tables of JSON snapshots, one document a file, each with the file as ``snapshot``."""
    fields = ", ".join(f"{k} array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in v.split(', ')))}>>" for k, v in SECTIONS.items())
    schema = f"{fields}, connections struct<current: long, peak: long, max_limit: long>, meta struct<engine: string, version: string, db_size_bytes: long, is_delta: boolean, collected_at: string>"
    d = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("snapshot", F.col("_metadata.file_path"))
    out = {k: d.select("snapshot", F.inline(k)) for k in SECTIONS}
    out["indexes"] = out["indexes"].withColumns({"columns": index_columns(F.col("definition")), "method": F.coalesce(F.nullif(F.lower(F.regexp_extract("definition", r"(?i)\busing\s+(\w+)", 1)), F.lit("")), F.lit("btree"))})
    for k in ("connections", "meta"):
        out[k] = d.where(F.col(k).isNotNull()).select("snapshot", f"{k}.*")
    return out


def index_columns(definition: Column) -> Column:
    """Columns in the last pair of parentheses of an index definition."""
    inner = F.regexp_extract(definition, r"\(([^()]*)\)[^()]*$", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda c: F.lower(F.regexp_extract(F.trim(c), r"^[\"`]?(\w+)", 1))), lambda c: c != "")


def read_ddl(spark: SparkSession, path: str) -> DataFrame:
    """kind, name of every object that SQL files create."""
    d = spark.read.option("wholetext", "true").text(path).select(F.regexp_replace(F.regexp_replace("value", r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " ").alias("sql"))
    p = r"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:unique\s+|temp(?:orary)?\s+|materialized\s+)*(table|index|view|function|procedure)\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?([\w.\"`]+)"
    pairs = F.arrays_zip(F.regexp_extract_all("sql", F.lit(p), F.lit(1)).alias("kind"), F.regexp_extract_all("sql", F.lit(p), F.lit(2)).alias("name"))
    return d.select(F.explode(pairs).alias("p")).select(F.lower("p.kind").alias("kind"), F.regexp_replace("p.name", r"[\"`]", "").alias("name"))


SKIPPED = ("build", "target", "out", "node_modules", ".git", ".gradle", ".idea")


def read_sources(spark: SparkSession, path: str, most_bytes: int = 5_000_000) -> DataFrame:
    """path, source of Java, Kotlin and Scala files, build folders and huge files left out."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{java,kt,scala}").load(path)
    skip = "/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    return d.where((F.col("length") <= most_bytes) & ~F.col("path").rlike(skip)).select("path", F.decode("content", "UTF-8").alias("source"))


def masked(source: Column) -> Column:
    """Source with comments and literals blanked, so that what is left are names and braces."""
    s = F.regexp_replace(source, r"(?s)/\*.*?\*/", " ")
    s = F.regexp_replace(s, r'"(?:[^"\\\n]|\\.)*"', '""')
    s = F.regexp_replace(s, r"'(?:[^'\\\n]|\\.)+'", "' '")
    return F.regexp_replace(s, r"//[^\n]*", "")


def symbols(sources: DataFrame) -> DataFrame:
    """path, package, kind (type or method), name of what each file declares, lexically."""
    clean = sources.select("path", masked(F.col("source")).alias("s"))
    package = F.regexp_extract("s", r"(?m)^\s*package\s+([\w.]+)", 1)
    types = F.regexp_extract_all("s", F.lit(r"\b(?:class|interface|enum|record|object|trait)\s+([A-Z]\w*)"), F.lit(1))
    java = F.regexp_extract_all("s", F.lit(r"(?:(?:public|protected|private|static|final|synchronized|abstract|native)\s+)+(?:<[^>]+>\s+)?[\w<>\[\],.? ]+\s+([a-z]\w*)\s*\([^)]*\)\s*(?:throws\s+[\w., ]+)?\s*[{;]"), F.lit(1))
    other = F.regexp_extract_all("s", F.lit(r"\b(?:fun|def)\s+(?:<[^>]+>\s+)?(?:\w+\.)?(\w+)\s*[(\[=:]"), F.lit(1))
    each = F.concat(F.transform(types, lambda n: F.struct(F.lit("type").alias("kind"), n.alias("name"))), F.transform(F.concat(java, other), lambda n: F.struct(F.lit("method").alias("kind"), n.alias("name"))))
    return clean.select("path", package.alias("package"), F.explode(F.array_distinct(each)).alias("x")).select("path", "package", "x.*")


def references(sources: DataFrame, classes: DataFrame) -> DataFrame:
    """path, class_name, kind (new, import or use) of the classes (class_name) that files refer to."""
    s = sources.select("path", masked(F.col("source")).alias("s"))
    names = s.select("path", "s", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(r"\b([A-Z]\w*)\b"), F.lit(1)))).alias("simple"))
    c = classes.select("class_name", F.substring_index("class_name", ".", -1).alias("simple"), F.regexp_replace("class_name", r"\.[^.]*$", "").alias("package"))
    j = names.join(few(c), "simple")
    has = lambda *p: F.contains(F.col("s"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in p]))
    same = F.regexp_extract("s", r"(?m)^\s*package\s+([\w.]+)", 1) == F.col("package")
    known = has("import ", F.col("class_name")) | has("import ", F.col("package"), ".*") | same
    return j.where(known).select("path", "class_name", F.when(has("new ", F.col("simple")), "new").when(has("import ", F.col("class_name")), "import").otherwise("use").alias("kind"))


def fields(sources: DataFrame) -> DataFrame:
    """path, field, type of the fields that files declare with a modifier, lexically."""
    p = r"(?m)^\s*(?:(?:public|protected|private|static|final|volatile|transient)\s+)+([\w<>\[\],.?]+(?:\s*<[^;=]*>)?)\s+(\w+)\s*(?:=|;)"
    s = masked(F.col("source"))
    pairs = F.arrays_zip(F.regexp_extract_all(s, F.lit(p), F.lit(1)).alias("type"), F.regexp_extract_all(s, F.lit(p), F.lit(2)).alias("field"))
    return sources.select("path", F.explode(pairs).alias("x")).select("path", "x.field", "x.type")


# fixed values: methods of collections and caches that may fill or empty the field they are called on
FILLS = ("put", "putAll", "putIfAbsent", "add", "addAll", "offer", "push", "set", "compute", "computeIfAbsent", "merge", "register", "addListener")
EMPTIES = ("remove", "removeAll", "removeIf", "clear", "poll", "pop", "invalidate", "invalidateAll", "cleanUp", "unregister", "removeListener")


def field_operations(sources: DataFrame) -> DataFrame:
    """path, field, operation, category of what files do to their own fields, lexically: calls on a field and
    assignments. category: candidate_write, candidate_cleanup (null is assigned, or a method that empties)
    or other_usage. A name that is declared anew in the file, as local or parameter, counts only behind
    ``this.``."""
    s = sources.select("path", masked(F.col("source")).alias("s"))
    call = r"(?<![\w.])(this\s*\.\s*)?([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*\("
    put = r"(?:^|[;{})])\s*(this\s*\.\s*)?([A-Za-z_]\w*)\s*=(?!=)\s*(null\s*;)?"
    group = lambda p, i: F.regexp_extract_all("s", F.lit(p), F.lit(i))
    calls = F.transform(F.arrays_zip(group(call, 1).alias("own"), group(call, 2).alias("field"), group(call, 3).alias("what")), lambda x: F.struct((x["own"] != "").alias("own"), x["field"].alias("field"), x["what"].alias("operation")))
    puts = F.transform(F.arrays_zip(group(put, 1).alias("own"), group(put, 2).alias("field"), group(put, 3).alias("what")), lambda x: F.struct((x["own"] != "").alias("own"), x["field"].alias("field"), F.when(x["what"] == "", "assignment").otherwise("null assignment").alias("operation")))
    each = s.select("path", "s", F.explode(F.concat(calls, puts)).alias("x")).select("path", "s", "x.*")
    d = each.join(fields(sources).select("path", "field").distinct(), ["path", "field"])
    anew = F.concat(F.lit(r"[\w>\]]\s+"), F.col("field"), F.lit(r"\s*[=;,):]"))
    d = d.where(F.col("own") | (F.regexp_count("s", anew) <= 1))
    write, clean = F.col("operation").isin("assignment", *FILLS), F.col("operation").isin("null assignment", *EMPTIES)
    return d.select("path", "field", "operation", F.when(write, "candidate_write").when(clean, "candidate_cleanup").otherwise("other_usage").alias("category"))


def method_context(sources: DataFrame, wanted: DataFrame, most: int = 200) -> DataFrame:
    """path, method, first_line, body of the methods asked for (path, method): from the declaring line to
    the brace that closes it, at most so many lines."""
    d = sources.join(wanted, "path").withColumn("l", F.split("source", "\n"))
    decl = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("i"), (F.rlike(x, F.concat(F.lit("\\b"), F.col("method"), F.lit("\\s*\\([^;]*$"))) & ~x.rlike(r"^\s*(?:return|new|//)")).alias("hit"))), lambda x: x["hit"])
    d = d.withColumn("at", F.get(decl, F.lit(0))["i"]).where("at is not null").withColumn("part", F.slice("l", F.col("at") + 1, most))
    braces = lambda x: F.length(F.regexp_replace(x, "[^{]", "")) - F.length(F.regexp_replace(x, "[^}]", ""))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("opened"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        depth = a["depth"] + braces(x)
        opened = a["opened"] | x.contains("{")
        return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), opened.alias("opened"), (a["n"] + 1).alias("n"), (opened & (depth <= 0)).alias("done")))

    n = F.aggregate("part", zero, step, lambda a: a["n"])
    return d.select("path", "method", (F.col("at") + 1).alias("first_line"), F.array_join(F.slice("part", F.lit(1), n), "\n").alias("body"))


def display_value(sample: Column, coder: Column) -> Column:
    """Text of the sampled bytes (hex) of a string: one byte a character for coder 0, two for coder 1."""
    return F.when(coder == 1, F.decode(F.unhex(sample), "UTF-16LE")).otherwise(F.decode(F.unhex(sample), "ISO-8859-1"))


def lookup(found: DataFrame, classes: DataFrame) -> DataFrame:
    """class_name, path where exactly one file declares the class."""
    t = found.where("kind = 'type'").select(F.concat_ws(".", F.nullif("package", F.lit("")), "name").alias("class_name"), "path").distinct()
    one = t.withColumn("k", F.count("*").over(Window.partitionBy("class_name"))).where("k = 1").drop("k")
    return classes.select("class_name").distinct().join(one, "class_name")


# ---- sinks


def guarded(c: Column) -> Column:
    """Text that a spreadsheet doesn't take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def write_histogram_csv(hist: DataFrame, path: str) -> None:
    hist.select(guarded(F.col("class_name")).alias("class_name"), "instances", "bytes").orderBy(F.desc("bytes"), "class_name").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def report_json(ranked: DataFrame, top: int = 20) -> str:
    """The top findings as JSON, numbers rounded to six places; at most ``top`` rows reach the driver."""
    rows = ranked.where(F.col("rank") <= top).orderBy("rank").limit(top).collect()
    tidy = [{k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict(True).items()} for r in rows]
    return json.dumps({"findings": tidy}, sort_keys=True, default=str)


def report_text(ranked: DataFrame, top: int = 20) -> str:
    rows = ranked.where(F.col("rank") <= top).orderBy("rank").limit(top).collect()
    return "\n".join(f"{r['rank']:>3}. [{r['type']}] {r['signature']}: at {r['site']} expected {r['expected']} x{r['occurrences']} score {r['score']:.6f}" for r in rows)
