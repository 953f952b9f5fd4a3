"""Database-snapshot rules. Every rule turns section tables into findings of one shape:
rule, category, severity, object, confidence, impact.

Thresholds named in comments as ours aren't published anywhere and are this engine's choice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.session import cut_lineage

MB, GB = 1 << 20, 1 << 30
# fixed values: points per severity
POINTS = {"CRITICAL": 15, "HIGH": 8, "MEDIUM": 3, "LOW": 1, "INFO": 0}
#: Caps of the points of a category; that of queries is given, the others are ours.
CAPS = {"queries": 30, "indexes": 20, "config": 20, "ops": 20, "maintenance": 15, "procedures": 15}
CONTROL = r"(?i)^\s*(COMMIT|BEGIN|ROLLBACK|START TRANSACTION|SET|SHOW)\b"


def _out(d: DataFrame, rule: str, category: str, severity: Column, obj: Column, impact: Column, confidence: Column | str = "high") -> DataFrame:
    c = F.lit(confidence) if isinstance(confidence, str) else confidence
    d = d.select(F.lit(rule).alias("rule"), F.lit(category).alias("category"), severity.alias("severity"), obj.alias("object"), c.alias("confidence"), impact.cast("double").alias("impact"))
    return d.where("severity is not null")


def delta(now: DataFrame, before: DataFrame, days: float) -> DataFrame:
    """Counters since the baseline as calls and time a day; digests that repeat on either side are left
    out, as are counters that went back."""
    one = lambda d: d.groupBy("query_digest").agg(F.count("*").alias("k"), F.first("calls").alias("calls"), F.first("total_time_ms").alias("total_time_ms")).where("k = 1").drop("k")
    b = one(before).select("query_digest", F.col("calls").alias("_c"), F.col("total_time_ms").alias("_t"))
    d = one(now).join(b, "query_digest").where((F.col("calls") >= F.col("_c")) & (F.col("total_time_ms") >= F.col("_t")))
    return d.select("query_digest", ((F.col("calls") - F.col("_c")) / days).alias("calls_per_day"), ((F.col("total_time_ms") - F.col("_t")) / days).alias("time_per_day_ms"))


def q1(queries: DataFrame) -> DataFrame:
    """Queries that take a fifth or more of all captured time."""
    total = queries.agg(F.sum("total_time_ms").alias("t")).select("t").scalar()
    pct = F.try_divide(F.col("total_time_ms") * 100, total)
    return _out(queries, "R-Q1", "queries", F.when(pct > 40, "CRITICAL").when(pct >= 20, "HIGH"), F.col("query_digest"), pct)


def q2(queries: DataFrame) -> DataFrame:
    """Queries slow on average (from a second on, ours); the more calls the more severe."""
    sev = F.when(F.col("mean_time_ms") < 1000, None).when(F.col("calls") >= 10_000, "HIGH").when(F.col("calls") >= 100, "MEDIUM").otherwise("LOW")
    return _out(queries, "R-Q2", "queries", sev, F.col("query_digest"), F.col("mean_time_ms"))


def q3(queries: DataFrame) -> DataFrame:
    """Queries called very often (from 50 000 a day or in total on, ours), transaction control left out."""
    rate = F.coalesce("calls_per_day", F.col("calls").cast("double"))
    d = queries.where(~F.col("normalized_sql").rlike(CONTROL))
    conf = F.when(F.col("calls_per_day").isNotNull(), "high").otherwise("low")
    return _out(d, "R-Q3", "queries", F.when(rate >= 50_000, "MEDIUM"), F.col("query_digest"), rate, conf)


def filter_columns(sql: Column) -> Column:
    """Columns compared with a parameter behind WHERE, in order."""
    where = F.regexp_extract(sql, r"(?is)\bwhere\b(.*)$", 1)
    return F.array_distinct(F.transform(F.regexp_extract_all(where, F.lit(r"(?i)([a-z_][a-z0-9_.]*)\s*=\s*(?:\?|\$\d+|:\w+)"), F.lit(1)), lambda c: F.substring_index(c, ".", -1)))


def i1(tables: DataFrame, queries: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tables scanned whole again and again while queries filter on columns that lead no index.
    indexes carry table (with schema) and columns."""
    t = tables.where((F.col("size_bytes") >= 100 * MB) & (F.col("seq_scans") >= 1000)).select("schema_name", "name", "size_bytes")  # both bounds ours
    q = queries.select(F.lower(F.regexp_extract("normalized_sql", r"(?i)\bfrom\s+([a-z_0-9.]+)", 1)).alias("t"), filter_columns(F.col("normalized_sql")).alias("cols"), "total_time_ms").where(F.size("cols") > 0)
    # a query names a table with or without its schema
    named = t.withColumn("t", F.explode(F.array(F.lower("name"), F.lower(F.concat_ws(".", "schema_name", "name")))))
    j = named.join(q, "t")
    lead = indexes.select(F.col("table").alias("_t"), F.get("columns", F.lit(0)).alias("_lead")).distinct()
    j = j.join(lead, (F.col("_t") == F.concat_ws(".", "schema_name", "name")) & (F.col("_lead") == F.get("cols", F.lit(0))), "left_anti")
    g = j.groupBy("name").agg(F.max("size_bytes").alias("size_bytes"), F.sum("total_time_ms").alias("ms"))
    return _out(g, "R-I1", "indexes", F.when(F.col("size_bytes") >= GB, "HIGH").otherwise("MEDIUM"), F.col("name"), F.col("ms"), "medium")


def i2(indexes: DataFrame) -> DataFrame:
    """Indexes never scanned, of 10 MB or more (ours), primary and unique ones left out; unknown scans
    are no evidence."""
    d = indexes.where("scans = 0 and not is_primary and not is_unique").where(F.col("size_bytes") >= 10 * MB)
    return _out(d, "R-I2", "indexes", F.when(F.col("size_bytes") >= 100 * MB, "MEDIUM").otherwise("LOW"), F.concat_ws(".", "table", "name"), F.col("size_bytes"), "medium")


def i3(indexes: DataFrame) -> DataFrame:
    """Plain indexes whose columns begin another index of the table; of equal ones all but what a unique
    or primary index or the other of the pair covers. Unique ones are never redundant."""
    a, b = indexes.where("not is_primary and not is_unique and method = 'btree'").alias("a"), indexes.where("method = 'btree'").alias("b")
    prefix = F.slice(F.col("b.columns"), 1, F.size("a.columns")) == F.col("a.columns")
    j = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.name") != F.col("b.name")) & prefix, "left_semi")
    return _out(j, "R-I3", "indexes", F.lit("LOW"), F.concat_ws(".", "table", "name"), F.col("size_bytes"))


def l1(lock_waits: DataFrame) -> DataFrame:
    """Long lock waits: from a second MEDIUM (ours), from five HIGH (ours)."""
    ms = F.col("wait_ms")
    return _out(lock_waits, "R-L1", "ops", F.when(ms >= 5000, "HIGH").when(ms >= 1000, "MEDIUM"), F.concat_ws(">", "blocker_digest", "blocked_digest"), ms)


def c1(connections: DataFrame) -> DataFrame:
    """Connections near the limit, on the larger of current and peak."""
    n = F.greatest("current", "peak")
    pct = F.try_divide(n * 100.0, F.col("max_limit"))
    conf = F.when(F.col("peak").isNull(), "medium").otherwise("high")
    return _out(connections, "R-C1", "ops", F.when(pct >= 95, "CRITICAL").when(pct >= 80, "HIGH"), F.lit("connections"), pct, conf)


def g1(tables: DataFrame) -> DataFrame:
    """Large tables that grow fast, with the size in 90 days if that goes on."""
    d = tables.where((F.col("size_bytes") >= 100 * MB) & (F.col("growth_30d_pct") >= 20))  # both bounds ours
    return _out(d, "R-G1", "ops", F.lit("MEDIUM"), F.concat_ws(".", "schema_name", "name"), F.col("size_bytes") * (1 + 3 * F.col("growth_30d_pct") / 100), "medium")


def maintenance(tables: DataFrame, engine: str, settings: DataFrame | None = None) -> DataFrame:
    """Dead rows, missing vacuum and bloat of one engine; fragmentation of the other."""
    name, dead, size = F.concat_ws(".", "schema_name", "name"), F.col("dead_tuple_ratio"), F.col("size_bytes")
    if engine == "mysql":
        pct = F.try_divide(F.col("data_free_bytes") * 100.0, size)
        return _out(tables, "R-M4", "maintenance", F.when((F.col("data_free_bytes") >= 100 * MB) & (pct >= 20), "LOW"), name, pct)  # bounds ours
    parts = [
        _out(tables, "R-M1", "maintenance", F.when(dead >= 0.4, "HIGH").when(dead >= 0.2, "MEDIUM"), name, dead),
        _out(tables.where(F.col("last_autovacuum").isNull()), "R-M2", "maintenance", F.when((size >= 100 * MB) & (dead >= 0.05), "MEDIUM"), name, dead),
        _out(tables, "R-M3", "maintenance", F.when((size >= 512 * MB) & (dead >= 0.1), "LOW"), name, size * dead, "low"),
    ]
    if settings is not None:
        parts.append(_out(settings.where((F.col("name") == "autovacuum") & (F.lower("value") == "off")), "R-M2", "maintenance", F.lit("HIGH"), F.lit("autovacuum"), F.lit(1.0)))
    return reduce(DataFrame.unionByName, parts)


def setting_number(value: Column, unit: Column) -> Column:
    """A setting as bytes or a plain number; units such as 8kB count blocks of that size."""
    n = F.coalesce(F.regexp_extract(unit, r"^(\d+)", 1).try_cast("double"), F.lit(1.0))
    scale = F.when(unit.rlike("(?i)kB$"), 1024.0).when(unit.rlike("(?i)MB$"), 1048576.0).when(unit.rlike("(?i)GB$"), 1073741824.0).otherwise(1.0)
    return value.try_cast("double") * F.when(unit.isNull(), 1.0).otherwise(n * scale)


def config(settings: DataFrame, engine: str, db_size: int, largest_table: int = 0) -> DataFrame:
    """Checks of server settings (name, value, unit); with a column ``server`` those of many servers, each checked
    for itself, and objects are ``server.name``."""
    s = settings.withColumn("n", setting_number(F.col("value"), F.col("unit")))
    many = "server" in settings.columns
    row = s.groupBy(*(["server"] if many else [])).agg(F.map_from_entries(F.collect_list(F.struct(F.lower("name"), F.struct("value", "n")))).alias("m"))  # some dozen settings
    num = lambda k: F.try_element_at("m", F.lit(k))["n"]
    txt = lambda k: F.upper(F.try_element_at("m", F.lit(k))["value"])
    if engine == "postgres":
        checks = [
            ("shared_buffers", F.when((num("shared_buffers") < 256 * MB) & F.lit(db_size > 4 * num_gb(1)), "LOW")),
            ("effective_cache_size", F.when(num("effective_cache_size") == 4 * GB, "LOW")),
            ("work_mem", F.when(num("work_mem") * num("max_connections") >= 16 * GB, "MEDIUM")),
            ("random_page_cost", F.when(num("random_page_cost") >= 4, "LOW")),
            ("track_io_timing", F.when(txt("track_io_timing") == "OFF", "INFO")),
            ("autovacuum", F.when(txt("autovacuum") == "OFF", "HIGH")),
            ("autovacuum_vacuum_scale_factor", F.when((num("autovacuum_vacuum_scale_factor") >= 0.2) & F.lit(largest_table >= 5 * GB), "LOW")),
            ("checkpoint_completion_target", F.when(num("checkpoint_completion_target") < 0.7, "LOW")),
            ("max_connections", F.when(num("max_connections") > 500, "MEDIUM")),
            ("maintenance_work_mem", F.when((num("maintenance_work_mem") <= 64 * MB) & F.lit(db_size > 10 * GB), "LOW")),
        ]
    else:
        hit = 100 * (1 - F.try_divide(num("innodb_buffer_pool_reads"), num("innodb_buffer_pool_read_requests")))
        checks = [
            ("innodb_buffer_pool_size", F.when((hit < 99) & (num("innodb_buffer_pool_size") < db_size), F.when(hit < 95, "HIGH").otherwise("MEDIUM"))),
            ("sync_binlog / innodb_flush_log_at_trx_commit", F.when((num("sync_binlog") != 1) | (num("innodb_flush_log_at_trx_commit") != 1), "INFO")),
            ("innodb_log_file_size", F.when(num("innodb_log_file_size") < 256 * MB, "LOW")),
            ("tmp_table_size", F.when(num("tmp_table_size") != num("max_heap_table_size"), "LOW")),
            ("table_open_cache", F.when(F.try_divide(num("opened_tables"), num("uptime")) > 1, "LOW")),
            ("thread_cache_size", F.when(F.try_divide(num("threads_created"), num("connections")) > 0.1, "LOW")),
            ("query_cache_type", F.when((txt("query_cache_type") == "ON") & (num("query_cache_size") > 0), "MEDIUM")),
            ("slow_query_log", F.when(txt("slow_query_log") == "OFF", "INFO")),
            ("performance_schema", F.when(txt("performance_schema") == "OFF", "INFO")),
            ("max_connections", F.when(num("max_connections") > 2000, "MEDIUM")),
        ]
    d = row.select(*(["server"] if many else []), F.explode(F.array(*[F.struct(F.lit(k).alias("o"), c.alias("s")) for k, c in checks])).alias("c"))
    return _out(d, "R-CFG-PG" if engine == "postgres" else "R-CFG-MY", "config", F.col("c.s"), F.concat_ws(".", "server", "c.o") if many else F.col("c.o"), F.lit(0.0))


def num_gb(n: int) -> int:
    return n * GB


def procedures(procs: DataFrame) -> DataFrame:
    """Lexical findings in routine bodies: cursors and loops, SELECT *, dynamic SQL, functions on compared
    columns, temporary tables without index. procs: (schema_name, name, definition)."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("definition", r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " "), r"'(?:[^']|'')*'", "''")
    low = F.lower(body)
    rules = [
        ("SP2", F.when(low.rlike(r"create\s+(?:global\s+|local\s+)?temp(?:orary)?\s+table") & ~low.rlike(r"create\s+(?:unique\s+)?index"), "LOW")),
        ("SP3", F.when(low.rlike(r"\bcursor\b|\bfetch\s+(?:next\s+)?from\b|\bloop\b"), "MEDIUM")),
        ("SP4", F.when(low.rlike(r"select\s+\*"), "LOW")),
        ("SP5", F.when(low.rlike(r"\bexecute\s+(?:immediate\b|format\s*\(|'|\w+\s*\|\|)|\bprepare\s+\w+\s+from\b|sp_executesql"), "MEDIUM")),
        ("SP6", F.when(low.rlike(r"\bwhere\b[^;]*\b(?:lower|upper|date|substr|substring|coalesce|cast|trim)\s*\(\s*[a-z_][\w.]*[^)]*\)\s*(?:=|<|>|like\b)"), "MEDIUM")),
    ]
    d = procs.select("schema_name", "name", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), c.alias("severity")) for k, c in rules])).alias("r")).where("r.severity is not null")
    return d.select("r.rule", F.lit("procedures").alias("category"), "r.severity", F.concat_ws(".", "schema_name", "name").alias("object"), F.lit("low").alias("confidence"), F.lit(0.0).alias("impact"))


# fixed values: names of one kind of type
TYPE_KINDS = (("int", r"^(?:tiny|small|medium|big)?int(?:eger)?\d*\b|^(?:big|small)?serial"), ("text", r"^(?:n?(?:var)?char|character|(?:tiny|medium|long)?text|uuid|enum)"), ("decimal", r"^(?:numeric|decimal|number)"), ("float", r"^(?:float|double|real)"), ("time", r"^(?:date|time|year)"), ("bool", r"^bool"))
_TYPE = r"((?:[a-z]+(?:\s+varying|\s+precision)?)\s*(?:\(\s*\d+(?:\s*,\s*\d+)?\s*\))?)"
_NO_TYPE = ("cursor", "from", "where", "as", "is", "in", "on", "and", "or", "then", "set", "into", "constant")


def type_kind(name: Column) -> Column:
    """The kind of a type; decimals of other precision or scale are of another kind."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"\s+", "")
    c = F.lit(None).cast("string")
    for kind, p in reversed(TYPE_KINDS):
        c = F.when(F.lower(F.trim(name)).rlike(p), F.concat(F.lit("decimal"), F.regexp_extract(low, r"\(.*\)", 0)) if kind == "decimal" else F.lit(kind)).otherwise(c)
    return c


def type_mismatches(procs: DataFrame, columns: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """Columns of routines that are compared for equality with variables, parameters or columns of temporary
    tables of another kind of type: rule, category, severity, object, confidence, impact, left, left_type,
    right, right_type.

    Lexical: procs (schema_name, name, definition), columns (schema_name, table, name, data_type),
    parameters (schema_name, routine, name, data_type). A table that several schemas have, a name declared
    twice, a bare name that a column of the routine's tables has as well, and routines with nested selects
    in a predicate are left alone.
    """
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("definition", r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " "), r"'(?:[^']|'')*'", "''")
    p = procs.select("schema_name", F.col("name").alias("routine"), F.lower(body).alias("s"))
    p = cut_lineage(p.where(~F.col("s").rlike(r"(?:exists|in|=|<|>)\s*\(\s*select\b")))
    key = ["schema_name", "routine"]
    pairs = lambda pattern, a, b: F.arrays_zip(F.regexp_extract_all("s", F.lit(pattern), F.lit(1)).alias(a), F.regexp_extract_all("s", F.lit(pattern), F.lit(2)).alias(b))
    declared = p.select(*key, F.explode(pairs(r"(?:\bdeclare|;)\s+(?!(?:begin|declare)\b)([a-z_]\w*)\s+" + _TYPE, "name", "type")).alias("x")).select(*key, "x.*").where(~F.split("type", r"[\s(]")[0].isin(*_NO_TYPE))
    if parameters is not None:
        declared = declared.unionByName(parameters.select("schema_name", "routine", F.lower("name").alias("name"), F.lower("data_type").alias("type")))
    declared = declared.where(type_kind(F.col("type")).isNotNull())
    declared = declared.groupBy(*key, "name").agg(F.first("type").alias("type"), F.count("*").alias("k")).where("k = 1").drop("k")
    named = p.select(*key, F.explode(pairs(r"\b(?:from|join|update)\s+([a-z_][\w.]*)(?:\s+(?:as\s+)?(?!(?:where|join|on|set|inner|left|right|cross|group|order|limit|union)\b)([a-z_]\w*))?", "table", "alias")).alias("x")).select(*key, "x.table", F.when(F.col("x.alias") != "", F.col("x.alias")).otherwise(F.substring_index("x.table", ".", -1)).alias("alias")).distinct()
    temp = p.select(*key, F.explode(pairs(r"create\s+(?:global\s+|local\s+)?temp(?:orary)?\s+table\s+(\w+)\s*\(((?:[^()]|\([^()]*\))*)\)", "table", "columns")).alias("x")).select(*key, "x.*")
    temp = temp.select(*key, "table", F.explode(F.regexp_extract_all("columns", F.lit(r"(?:^|,)\s*[a-z_]\w*\s+" + _TYPE), F.lit(0))).alias("c"))
    temp = temp.select(*key, "table", F.regexp_extract("c", r"^,?\s*([a-z_]\w*)", 1).alias("column"), F.trim(F.regexp_extract("c", r"^,?\s*[a-z_]\w*\s+(.*)$", 1)).alias("type"))
    c = columns.select(F.lower("schema_name").alias("cs"), F.lower("table").alias("ct"), F.lower("name").alias("column"), F.lower("data_type").alias("type"))
    plain = c.groupBy(F.col("ct").alias("table"), "column").agg(F.first("type").alias("type"), F.countDistinct("cs").alias("k")).where("k = 1").drop("k")
    full = c.groupBy(F.concat_ws(".", "cs", "ct").alias("table"), "column").agg(F.first("type").alias("type"))
    typed = named.join(plain.unionByName(full), "table").unionByName(named.join(temp, [*key, "table"]).select("table", *key, "alias", "column", "type"))
    typed = cut_lineage(typed.select(*key, F.concat_ws(".", "alias", "column").alias("name"), "column", "type").distinct())
    once = typed.groupBy(*key, "name").agg(F.first("type").alias("type"), F.count("*").alias("k")).where("k = 1").drop("k")
    bare = declared.join(typed.select(*key, F.col("column").alias("name")).distinct(), [*key, "name"], "left_anti")
    known = cut_lineage(once.unionByName(bare.select(*key, "name", "type")))
    equal = p.select(*key, F.explode(pairs(r"(?<![\w.])([a-z_]\w*(?:\.\w+)?)\s*=\s*([a-z_]\w*(?:\.\w+)?)(?![\w.(])", "left", "right")).alias("x")).select(*key, "x.*").distinct()
    side = lambda n: known.select(*key, F.col("name").alias(n), F.col("type").alias(f"{n}_type"))
    j = equal.join(side("left"), [*key, "left"]).join(side("right"), [*key, "right"]).where(type_kind(F.col("left_type")) != type_kind(F.col("right_type")))
    j = j.where(F.col("left").contains(".") | F.col("right").contains("."))
    return j.select(F.lit("SP1").alias("rule"), F.lit("procedures").alias("category"), F.lit("MEDIUM").alias("severity"), F.concat_ws(".", *key).alias("object"), F.lit("medium").alias("confidence"), F.lit(0.0).alias("impact"), "left", "left_type", "right", "right_type")


def redact(sql: Column) -> Column:
    """SQL without comments and with every literal a question mark; identifiers stay."""
    s = F.regexp_replace(sql, r"(?s)/\*.*?\*/", " ")
    s = F.regexp_replace(s, r"--[^\n]*", " ")
    s = F.regexp_replace(s, r"'(?:[^'\\]|''|\\.)*'", "?")
    s = F.regexp_replace(s, r"(?<![\w$])(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\b", "?")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def score(findings: DataFrame) -> DataFrame:
    """One row: 100 less the capped points of each category, not below 0."""
    p = findings.groupBy("category").agg(F.sum(F.element_at(_map(POINTS), F.col("severity"))).alias("points"))
    p = p.withColumn("deduction", F.least("points", F.coalesce(F.try_element_at(_map(CAPS), F.col("category")), F.lit(20))))
    return p.agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum("deduction"), F.lit(0))).alias("score"))


def ordered(findings: DataFrame) -> DataFrame:
    """Findings with their place: severity, then impact, then rule and object."""
    order = F.element_at(_map({k: i for i, k in enumerate(POINTS)}), F.col("severity"))
    # findings are few: rules times objects that break them
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order, F.desc("impact"), "rule", "object")))


def coverage(sections: dict[str, DataFrame | None], needed: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Status of every section: missing, empty, partial (a needed column absent) or available."""
    known = [d for d in (sections.get(k) for k in needed) if d is not None]
    if not known:
        return dict.fromkeys(needed, "missing")
    rows = coverage_table(sections, needed).select("section", "status").collect()  # a row for each section
    return {r.section: r.status for r in rows}


def coverage_table(sections: dict[str, DataFrame | None], needed: dict[str, tuple[str, ...]]) -> DataFrame:
    """section, status as of ``coverage``, rows of the section, and the needed columns it lacks; one job for all
    sections, of which one at least is there."""
    parts = []
    spark = next(d for d in sections.values() if d is not None).sparkSession
    for name, cols in needed.items():
        d = sections.get(name)
        lacking = sorted(set(cols) - set(d.columns)) if d is not None else list(cols)
        n = d.agg(F.count("*").alias("rows")) if d is not None else spark.range(1).select(F.lit(None).cast("bigint").alias("rows"))
        status = F.when(F.col("rows").isNull(), "missing").when(F.col("rows") == 0, "empty").when(F.lit(bool(lacking)), "partial").otherwise("available")
        parts.append(n.select(F.lit(name).alias("section"), status.alias("status"), "rows", F.lit(",".join(lacking)).alias("lacking")))
    return reduce(DataFrame.unionByName, parts)
