"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed by the SHA-256 of its text. A ledger
row says that one blob was scanned under one rule version, and what was found. Only pairs of blob
and rule version that the ledger lacks are scanned, each once however many paths hold the blob;
findings are then joined back to all paths and versions. A ledger is a Parquet table that grows by
the rows of each scan (``scan_into``).

Matches become rows, and their places running sums over the matches of one blob and rule, so that time
grows with the text and its matches and not with their product; masks are set by pieces of CHUNK
characters for the same reason.

Defined results: a null text is the empty text; very long texts are scanned whole, one text to a
task; repeated rows are reported each; an empty table gives an empty result; null paths and versions
are carried through; other columns are ignored, whatever their names. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlens.session import cut_lineage

RULE_VERSION = "3"
#: Blobs with findings up to which these are broadcast, some 200 bytes each.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Rule:
    """kind; the pattern, scanned leftmost and without overlap; the group whose length counts and
    its least length; a cheap test that any text with a finding passes; base rules set the digest."""

    kind: str
    pattern: str
    group: int
    least: int
    screen: str
    base: bool = True


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"'\x20]*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s{0,4}(?:(?:Proc-Type|DEK-Info): [\x20-\x7E]{0,200}\s{1,4}){0,2}[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY", False),
    # from the head of a run on, so that no text is gone over again and again
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ", False),
    Rule("hosttoken", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})", 0, 1, r"(?:gh[pousr]_|glpat-|xox[abprs]-)[A-Za-z0-9]", False),
)
SPAN = "array<struct<start:int,kind:int,stop:int>>"
#: Characters of the pieces that a text is cut to where masks are set.
CHUNK = 4_096


def lengths_of(text: Column, rule: Rule, index: int) -> Column:
    """array<struct<kind, at, gap, hit, key>> of one rule's matches: lengths of what stands before each, of
    the match and of the group that counts."""
    hit = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    key = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hit
    pairs = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hit.alias("hit"), key.alias("key"))
    n = lambda x, name: F.char_length(x[name]).alias(name)
    all_ = F.transform(pairs, lambda x, i: F.struct(F.lit(index).alias("kind"), i.alias("at"), n(x, "gap"), n(x, "hit"), n(x, "key")))
    return F.when(text.rlike(rule.screen), F.filter(all_, lambda x: x["hit"].isNotNull()))


def spans_of(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans of every blob (blob, text): all kept spans of all rules by start, then kind."""
    found = F.flatten(F.array_compact(F.array(*[lengths_of(F.col("text"), r, i) for i, r in enumerate(rules)])))
    each = blobs.select("blob", F.explode_outer(found).alias("m"))
    upto = F.sum(F.col("m.gap") + F.col("m.hit")).over(Window.partitionBy("blob", "m.kind").orderBy("m.at"))
    least = F.get(F.array(*[F.lit(r.least) for r in rules]), F.col("m.kind"))
    span = F.struct((upto - F.col("m.hit")).cast("int").alias("start"), F.col("m.kind").alias("kind"), upto.cast("int").alias("stop"))
    kept = each.select("blob", F.when(F.col("m.key") >= least, span).alias("span"))
    return kept.groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def address(versions: DataFrame, path_col: str, version_col: str | None, text_col: str) -> DataFrame:
    """path, version, text and blob id of every version of every path."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    version = F.col(version_col) if version_col else F.lit(0)
    return versions.select(F.col(path_col).alias("path"), version.alias("version"), text.alias("text"), F.sha2(text, 256).alias("blob"))


def scan_unseen(addressed: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the blobs not yet scanned under these rules.

    One copy of each blob crosses the shuffle from each map task; a blob without findings gets a
    row as well, so that it isn't scanned again.
    """
    fresh = addressed.select("blob", "text")
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        fresh = fresh.join(seen, "blob", "left_anti")
    one = fresh.groupBy("blob").agg(F.first("text").alias("text"))
    return spans_of(one, rules).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, path_col: str = "path", version_col: str | None = "version", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of every path and version, ledger rows to append)."""
    addressed = address(versions, path_col, version_col, text_col)
    # written before it is joined: it joins on its own, so that a blob with very many paths can be split
    added = cut_lineage(scan_unseen(addressed, ledger, rules, rule_version))
    known = added if ledger is None else added.unionByName(ledger.where(F.col("rule_version") == rule_version).select("blob", "rule_version", "spans"))
    return addressed.select("path", "version", "blob").join(known, "blob"), added


def scan_into(versions: DataFrame, path: str, **how) -> DataFrame:
    """Findings of every path and version, with the ledger at a path of a store that all executors
    share: read if it is there, and grown by what was scanned."""
    spark = versions.sparkSession
    try:
        ledger = cut_lineage(spark.read.parquet(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    findings, added = scan_versions(versions, ledger, **how)
    added.write.mode("append").parquet(path)
    return findings


def joined(spans: Column, rules: tuple[Rule, ...] = RULES, base_only: bool = False) -> Column:
    """Spans as comma-joined kind:start:stop."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    kept = F.filter(spans, lambda s: s["kind"].isin([i for i, r in enumerate(rules) if r.base])) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest_findings(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == [r.kind for r in rules].index(kind))).cast("bigint").alias(f"n_{kind}")
    return findings.select(
        F.col("path").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("spans"), rules, True), 256).alias("base_sha256"), joined(F.col("spans"), rules).alias("spans")
    )


def merged_spans(hits: DataFrame) -> DataFrame:
    """blob, spans array<struct<start, stop>>: those that touch or overlap made one."""
    each = hits.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.stop")
    in_order = Window.partitionBy("blob").orderBy("start", "stop")
    reached = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("first", (F.col("start") > F.coalesce(reached, F.lit(-1))).cast("int"))
    each = each.withColumn("part", F.sum("first").over(in_order))
    parts = each.groupBy("blob", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return parts.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """text with every one of its merged spans replaced by the mask."""

    def between(chunks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
        part = lambda k, at, n: F.substring(F.coalesce(F.get(chunks, k), F.lit("")), at, n)
        apart = F.concat(part(i, a % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), part(j, F.lit(1), b % CHUNK))
        return F.when(i == j, part(i, a % CHUNK + 1, b - a)).otherwise(apart)

    def masked(bound: Column) -> Column:
        chunks, n = bound["chunks"], bound["n"]
        stop = lambda i: F.when(i > 0, F.get(spans, i - 1)["stop"]).otherwise(0)
        pieces = F.transform(spans, lambda s, i: F.concat(between(chunks, stop(i), s["start"]), F.lit(mask)))
        return F.concat(F.array_join(pieces, ""), between(chunks, F.element_at(spans, -1)["stop"], n))

    # bound to a variable, which is computed once for a text
    bound = F.struct(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0)).alias("chunks"), F.char_length(text).alias("n"))
    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(bound), masked), F.lit(0))).otherwise(text)


def redact_documents(docs: DataFrame, ledger: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with every finding masked in text, and n_chars of the texts that changed set anew."""
    taken = {c.lower() for c in docs.columns}
    blob, spans = (next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken) for name in ("blob", "spans"))
    content = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    scanned = scan_unseen(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), content.alias("blob")), ledger)
    known = scanned if ledger is None else scanned.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", "spans"))
    hits = cut_lineage(merged_spans(known.where(F.size("spans") > 0)).select(F.col("blob").alias(blob), F.col("spans").alias(spans)))
    few = hits.count() <= broadcast_rows
    d = docs.withColumn(blob, content).join(F.broadcast(hits) if few else hits, blob, "left")
    text = F.when(F.col(spans).isNotNull(), redact(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(spans).isNotNull(), F.char_length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return d.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
