"""Deduplication, scoring, suppression and ranking of findings, and their validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlens.config import FlowConfig
from emberlens.operators.quantiles import numbered
from emberlens.session import cut_lineage

KEY = ("signature", "type", "index", "site", "expected")
# fixed values: severity of each finding type
SEVERITY = {"TRUNCATION": 1.0, "DIVERGENCE": 0.6, "TIMING": 0.3}
LATE = float("inf")


def dedupe(findings: DataFrame) -> DataFrame:
    """One representative per key, most severe first, with the number of occurrences. Nulls in the
    key are values."""
    first = F.struct(-F.col("raw_score"), F.coalesce("thread_id", F.lit("")), F.coalesce(F.col("start_ms").cast("double"), F.lit(LATE)), "flow_key", "ep")
    rest = F.struct("thread_id", "start_ms", "status", "has_error", "has_stack", "expected_share", "observed", "raw_score", "size")
    return findings.groupBy(*KEY).agg(F.count("*").alias("occurrences"), F.min_by(rest, first).alias("r")).select(*KEY, "occurrences", "r.*")


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def score(found: DataFrame, config: FlowConfig) -> DataFrame:
    """found with the parts of the score and their weighted sum."""
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("type"))
    broken = F.col("has_error") | F.col("has_stack")
    benign = (F.col("type") == "DIVERGENCE") & (F.col("status") == "COMPLETED") & ~broken
    d = found.withColumns(
        {
            "rarity": F.when(F.col("size") <= 0, F.lit(0.0)).otherwise(_unit(1.0 - F.col("occurrences") / F.col("size"))),
            "severity": severity,
            "error_presence": F.when(broken, F.lit(1.0)).otherwise(0.0),
            "magnitude": F.when(F.col("type") == "TIMING", _unit(F.log10(F.greatest(F.col("raw_score"), F.lit(1.0))) / 2.0)).otherwise(0.0),
            "trust": _unit(F.log10(F.greatest(F.col("size"), F.lit(1)).cast("double")) / 3.0),
            "variant_penalty": F.when(benign, F.lit(float(config.benign_variant_penalty))).otherwise(1.0),
        }
    )
    parts = (("rarity_weight", "rarity"), ("severity_weight", "severity"), ("error_weight", "error_presence"), ("magnitude_weight", "magnitude"), ("cluster_size_weight", "trust"))
    total = sum((F.lit(float(getattr(config, w))) * F.col(c) for w, c in parts[1:]), F.lit(float(config.rarity_weight)) * F.col("rarity"))
    return d.withColumn("score", F.col("variant_penalty") * total)


def suppress(found: DataFrame, rules: Sequence[Mapping[str, str | None]]) -> DataFrame:
    """suppressed and the reason of the first rule that fits; a field that a rule leaves out fits all."""
    reason = F.lit(None).cast("string")
    fits_any = F.lit(False)
    for rule in reversed(rules):
        fits = F.lit(True)
        for theirs, ours in (("clusterSignature", "signature"), ("divergenceCallSite", "site"), ("type", "type")):
            if rule.get(theirs) is not None:
                fits &= F.coalesce(F.col(ours) == rule[theirs], F.lit(False))
        reason = F.when(fits, F.lit(rule.get("reason"))).otherwise(reason)
        fits_any |= fits
    return found.withColumns({"suppressed": fits_any, "reason": reason})


def ranked(found: DataFrame) -> DataFrame:
    """found with rank among those that aren't suppressed (null for the others)."""
    order = (F.desc("score"), "signature", F.coalesce("site", F.lit("")), "index", F.coalesce("thread_id", F.lit("")), F.coalesce(F.col("start_ms").cast("double"), F.lit(LATE)), "type", F.coalesce("expected", F.lit("")))
    kept = numbered(found.where(~F.col("suppressed")), order, "rank").withColumn("rank", F.col("rank").cast("int"))
    return kept.unionByName(found.where("suppressed").withColumn("rank", F.lit(None).cast("int")))


def rank_findings(findings: DataFrame, config: FlowConfig) -> DataFrame:
    return ranked(cut_lineage(suppress(score(dedupe(findings), config), config.suppressions)))


def locate(episodes: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (thread_id, at_ms) the episode of its thread that contains the time, else the
    one that starts nearest."""
    j = probes.join(episodes.select("thread_id", "flow_key", "ep", "start_ms", "end_ms"), "thread_id")
    inside = (F.col("start_ms") <= F.col("at_ms")) & (F.col("at_ms") <= F.col("end_ms"))
    order = F.struct(~F.coalesce(inside, F.lit(False)), F.when(F.coalesce(inside, F.lit(False)), F.col("start_ms")).otherwise(F.abs(F.col("start_ms") - F.col("at_ms"))), "start_ms", "ep")
    return j.where("start_ms is not null").groupBy("thread_id", "at_ms").agg(F.min_by(F.struct("flow_key", "ep", "start_ms", "end_ms"), order).alias("e")).select("thread_id", "at_ms", "e.*")


def validate(findings: DataFrame, ranking: DataFrame, defects: DataFrame, top_n: int) -> DataFrame:
    """Per defect (id, thread_id, from_ms, to_ms, expected_site): best rank of the findings of its
    thread and window, those at the expected site before all others; found if within top_n."""
    f = findings.select(*KEY, "thread_id", "start_ms")
    within = (F.col("from_ms").isNull() | (F.col("start_ms") >= F.col("from_ms"))) & (F.col("to_ms").isNull() | (F.col("start_ms") <= F.col("to_ms"))) & F.col("start_ms").isNotNull()
    j = defects.join(f, "thread_id").where(within)
    r = ranking.select(*[F.col(k).alias(f"_{k}") for k in KEY], "rank", "suppressed")
    j = j.join(r, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY])
    here = F.coalesce(F.col("site") == F.col("expected_site"), F.lit(False))
    g = j.groupBy("id").agg(F.count("*").alias("candidates"), F.count_if(here).alias("matching"), F.min(F.when(here, F.col("rank"))).alias("at_site"), F.min("rank").alias("anywhere"), F.max("suppressed").alias("any_suppressed"))
    out = defects.join(g, "id", "left")
    best = F.when(F.col("matching") > 0, F.col("at_site")).otherwise(F.col("anywhere"))
    note = (
        F.when(F.coalesce("candidates", F.lit(0)) == 0, "not detected")
        .when(best.isNull(), F.when(F.col("any_suppressed"), "detected but suppressed").otherwise("detected but not ranked"))
        .when(best <= top_n, f"in top {top_n}")
        .otherwise(f"ranked but below top {top_n}")
    )
    elsewhere = F.coalesce(best.isNotNull() & F.col("expected_site").isNotNull() & (F.col("matching") == 0), F.lit(False))
    return out.select("id", best.alias("best_rank"), F.coalesce(best <= top_n, F.lit(False)).alias("passed"), elsewhere.alias("elsewhere"), note.alias("note"))
