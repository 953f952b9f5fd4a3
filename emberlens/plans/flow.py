"""Queries of the flow analysis over the events table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.operators import baseline as B
from emberlens.operators import detect as D
from emberlens.operators import rank as R
from emberlens.operators import segment as S
from emberlens.plans.adapters import BASELINE_SQL, EPISODES_SQL, EVENTS_CONFIG, RANKING_SQL, RECORDS_SQL, event_records
from emberlens.session import cut_lineage, write_table

C = EVENTS_CONFIG
RULED = replace(C, suppressions=({"divergenceCallSite": "click", "type": "DIVERGENCE", "reason": "known variant"}, {"clusterSignature": "view > view", "reason": "browsing"}))
DEFECTS = [(f"d{i}", str(i), 1_704_067_200_000 + 86_400_000 * (i % 20), 1_704_067_200_000 + 86_400_000 * (i % 20 + 8), "purchase" if i % 2 else None) for i in range(1, 41)]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return S.group_key(event_records(spark, sf))


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    return S.episodes(S.idle_gap(_records(spark, sf), C.idle_gap_ms, C.terminal_sites))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return B.clustered(_episodes(spark, sf), C.signature_k, C.min_cluster_size)


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf).where(~F.col("under_sampled"))


@query("WITH " + RECORDS_SQL + " SELECT flow_key, count(*) AS n FROM (SELECT nullif(regexp_extract(props, '\"k\": ([0-9]+)', 1), '') AS flow_key FROM r) WHERE flow_key IS NOT NULL GROUP BY ALL")
def seg_group_key(spark, sf):
    return S.group_key(event_records(spark, sf), '"k": ([0-9]+)').groupBy("flow_key").agg(F.count("*").alias("n"))


@query("WITH " + EPISODES_SQL + " SELECT flow_key, ep, status, n_records, start_ms, end_ms, array_to_string(seq, ' > ') AS seq FROM e")
def seg_idle_gap(spark, sf):
    return _episodes(spark, sf).select("flow_key", "ep", "status", "n_records", "start_ms", "end_ms", F.array_join("seq", " > ").alias("seq"))


@query(
    "WITH "
    + RECORDS_SQL
    + """, a AS (SELECT *, sum((call_site = 'signup')::INT) OVER (PARTITION BY flow_key ORDER BY ts_ms, event_id)::BIGINT AS ep FROM r),
b AS (SELECT *, coalesce(sum((call_site = 'purchase')::INT) OVER (PARTITION BY flow_key, ep ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM a WHERE ep > 0)
SELECT flow_key, ep, CASE WHEN bool_or(level = 'ERROR') THEN 'ERRORED' WHEN bool_or(call_site = 'purchase') THEN 'COMPLETED' ELSE 'TRUNCATED' END AS status, string_agg(call_site, ' > ' ORDER BY ts_ms, event_id) AS seq FROM b WHERE done = 0 GROUP BY ALL"""
)
def seg_entry_marker(spark, sf):
    d = S.episodes(S.entry_marker(_records(spark, sf), C.entry_sites, C.terminal_sites))
    return d.select("flow_key", "ep", "status", F.array_join("seq", " > ").alias("seq"))


@query(
    "WITH "
    + RECORDS_SQL
    + """, k AS (SELECT *, regexp_extract(props, '"k": ([0-9]+)', 1) AS key FROM r)
SELECT key AS flow_key, count(*) AS n_records, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, md5(string_agg(call_site, ' > ' ORDER BY ts_ms, event_id)) AS seq_md5 FROM k WHERE key <> '' GROUP BY key"""
)
def seg_correlation(spark, sf):
    d = S.episodes(S.correlation(S.group_key(event_records(spark, sf), '"k": ([0-9]+)'), C.terminal_sites))
    return d.select("flow_key", "n_records", "start_ms", "end_ms", F.md5(F.array_join("seq", " > ")).alias("seq_md5"))


@query("WITH " + RECORDS_SQL + " SELECT flow_key, string_agg(event_id::VARCHAR, ',' ORDER BY ts_ms, event_id) AS arrival FROM r GROUP BY flow_key")
def seg_order(spark, sf):
    g = _records(spark, sf).groupBy("flow_key").agg(F.sort_array(F.collect_list(F.struct("o1", "o2"))).alias("r"))
    return g.select("flow_key", F.array_join(F.transform("r", lambda x: x["o2"].cast("string")), ",").alias("arrival"))


@query("WITH " + EPISODES_SQL + " SELECT status, count(*) AS n FROM e GROUP BY status")
def seg_status(spark, sf):
    return _episodes(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("WITH " + EPISODES_SQL + " SELECT flow_key, ep, string_agg(site || '@' || first_ms, ' > ' ORDER BY pos) AS runs FROM runs GROUP BY ALL")
def seg_collapse(spark, sf):
    text = F.array_join(F.transform("runs", lambda r: F.concat(r["site"], F.lit("@"), r["first_ms"].cast("string"))), " > ")
    return _episodes(spark, sf).select("flow_key", "ep", text.alias("runs"))


_BUCKET = "CASE " + " ".join(f"WHEN n <= {b} THEN '<={b}'" for b in (1, 2, 5, 10)) + " ELSE '>10' END"


@query("WITH " + EPISODES_SQL + f", b AS (SELECT n_records AS n FROM e) SELECT 'records' AS what, {_BUCKET} AS bucket, count(*) AS episodes FROM b GROUP BY ALL UNION ALL SELECT 'threads', {_BUCKET}, count(*) FROM (SELECT count(*) AS n FROM e GROUP BY flow_key) GROUP BY ALL")
def seg_stats(spark, sf):
    e, bounds = _episodes(spark, sf), (1, 2, 5, 10)
    a = e.groupBy(S.record_histogram(F.col("n_records"), bounds).alias("bucket")).agg(F.count("*").alias("episodes")).select(F.lit("records").alias("what"), "bucket", "episodes")
    t = e.groupBy("flow_key").agg(F.count("*").alias("n")).groupBy(S.record_histogram(F.col("n"), bounds).alias("bucket")).agg(F.count("*").alias("episodes"))
    return a.unionByName(t.select(F.lit("threads").alias("what"), "bucket", "episodes"))


@query("WITH " + EPISODES_SQL + " SELECT flow_key, ep, end_ms - start_ms AS lasted_ms FROM e ORDER BY lasted_ms DESC, flow_key, ep LIMIT 10")
def seg_longest(spark, sf):
    return _episodes(spark, sf).select("flow_key", "ep", (F.col("end_ms") - F.col("start_ms")).alias("lasted_ms")).orderBy(F.desc("lasted_ms"), "flow_key", "ep").limit(10)


@query("WITH " + EPISODES_SQL + " SELECT flow_key, ep, signature FROM m")
def clu_signature(spark, sf):
    return _episodes(spark, sf).select("flow_key", "ep", B.signature(C.signature_k).alias("signature"))


@query("WITH " + EPISODES_SQL + " SELECT signature, count(*) AS size, count(*) < 10 AS under_sampled FROM m GROUP BY signature")
def clu_group(spark, sf):
    return B.clusters(_episodes(spark, sf), C.signature_k, C.min_cluster_size)


@query("WITH " + EPISODES_SQL + ", c AS (SELECT signature, count(*) AS n FROM m GROUP BY signature) SELECT CASE WHEN n <= 10 THEN '<=10' WHEN n <= 50 THEN '<=50' WHEN n <= 200 THEN '<=200' ELSE '>200' END AS bucket, count(*) AS clusters, sum(n)::BIGINT AS episodes, count(*) FILTER (n < 10) AS under_sampled FROM c GROUP BY ALL")
def clu_report(spark, sf):
    c = B.clusters(_episodes(spark, sf), C.signature_k, C.min_cluster_size)
    return c.groupBy(S.record_histogram(F.col("size"), (10, 50, 200)).alias("bucket")).agg(F.count("*").alias("clusters"), F.sum("size").alias("episodes"), F.count_if("under_sampled").alias("under_sampled"))


@query("WITH " + EPISODES_SQL + " SELECT signature, count(*) AS n FROM m WHERE start_ms >= 1704672000000 AND start_ms < 1705276800000 GROUP BY signature")
def base_window(spark, sf):
    return _members(spark, sf).where(B.in_window(F.col("start_ms"), 1_704_672_000_000, 1_705_276_800_000)).groupBy("signature").agg(F.count("*").alias("n"))


@query("WITH " + BASELINE_SQL + " SELECT signature, array_to_string(modal, ' > ') AS modal, modal_count, total, modal_share FROM modal")
def base_modal(spark, sf):
    return B.modal(_sampled(spark, sf)).withColumn("modal", F.array_join("modal", " > "))


@query(SQL["base_modal"])
def flow_modal_sequences(spark, sf):
    return base_modal(spark, sf)


@query("WITH " + BASELINE_SQL + " SELECT signature, rank - 1 AS rank, array_to_string(sites, ' > ') AS path, n, n / total AS share FROM pr WHERE rank BETWEEN 2 AND 6")
def base_alternatives(spark, sf):
    return B.alternatives(_sampled(spark, sf), C.alternatives).withColumn("path", F.array_join("path", " > "))


@query("WITH " + BASELINE_SQL + " SELECT signature, pos, site, n, share, rank FROM options")
def base_positional(spark, sf):
    return B.positional(_sampled(spark, sf))


@query("WITH " + BASELINE_SQL + ", c AS (SELECT signature, src, dst, count(*) AS n FROM steps WHERE size >= 10 GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY signature, src) AS share FROM c")
def base_transition(spark, sf):
    return B.transitions(_sampled(spark, sf))


@query("WITH " + BASELINE_SQL + " SELECT * FROM timing")
def base_timing(spark, sf):
    return B.timings(_sampled(spark, sf))


@query("WITH " + BASELINE_SQL + " SELECT * FROM timing ORDER BY p95_ms DESC, signature, src, dst LIMIT 10")
def base_slowest(spark, sf):
    return B.slowest(_sampled(spark, sf), 10)


@query("WITH " + BASELINE_SQL + ", x AS (SELECT m.flow_key, m.ep, list_transform(m.sites, lambda s: chr((64 + list_position(list_sort(list_distinct(list_concat(m.sites, modal.modal))), s))::INT)) AS a, list_transform(modal.modal, lambda s: chr((64 + list_position(list_sort(list_distinct(list_concat(m.sites, modal.modal))), s))::INT)) AS b FROM m JOIN modal ON m.signature = modal.signature) SELECT flow_key, ep, levenshtein(array_to_string(a, ''), array_to_string(b, '')) AS distance FROM x")
def seq_edit_distance(spark, sf):
    m = _sampled(spark, sf)
    return m.join(B.modal(m), "signature").select("flow_key", "ep", D.edit_distance(F.col("path"), F.col("modal")).alias("distance"))


@query("WITH " + BASELINE_SQL + ", x AS (SELECT flow_key, ep, sites, modal, coalesce(list_min([i FOR i IN range(1, least(len(sites), len(modal)) + 1) IF sites[i] <> modal[i]]) - 1, least(len(sites), len(modal))) AS pre FROM judged) SELECT flow_key, ep, pre AS prefix FROM x")
def seq_prefix(spark, sf):
    m = _sampled(spark, sf)
    return m.join(B.modal(m), "signature").select("flow_key", "ep", D.prefix_length(F.col("path"), F.col("modal")).alias("prefix"))


@query("WITH " + BASELINE_SQL + ", x AS (SELECT flow_key, ep, sites, modal, coalesce(list_min([i FOR i IN range(1, least(len(sites), len(modal)) + 1) IF sites[i] <> modal[i]]) - 1, least(len(sites), len(modal))) AS pre FROM judged) SELECT flow_key, ep, pre AS index, sites[pre + 1] AS site, CASE WHEN pre >= len(modal) THEN 'INSERTION' ELSE 'SUBSTITUTION' END AS kind FROM x WHERE pre < len(sites)")
def seq_first_div(spark, sf):
    m = _sampled(spark, sf)
    d = m.join(B.modal(m), "signature").select("flow_key", "ep", D.first_divergence(F.col("modal"), F.col("path")).alias("d")).where("d is not null")
    return d.select("flow_key", "ep", "d.*")


_FINDING_SQL = " SELECT flow_key, ep, signature, site, index, expected, expected_share, observed, raw_score FROM f WHERE type = '{}'"


def _findings(spark, sf, kind):
    d = D.findings(_members(spark, sf), C).where(F.col("type") == kind)
    return d.select("flow_key", "ep", "signature", "site", "index", "expected", "expected_share", "observed", "raw_score")


@query("WITH " + BASELINE_SQL + _FINDING_SQL.format("TRUNCATION"))
def det_truncation(spark, sf):
    return _findings(spark, sf, "TRUNCATION")


@query("WITH " + BASELINE_SQL + _FINDING_SQL.format("DIVERGENCE"))
def det_divergence(spark, sf):
    return _findings(spark, sf, "DIVERGENCE")


@query("WITH " + BASELINE_SQL + _FINDING_SQL.format("TIMING"))
def det_timing(spark, sf):
    return _findings(spark, sf, "TIMING")


@query("WITH " + BASELINE_SQL + " SELECT flow_key, ep, censored FROM judged")
def det_censor(spark, sf):
    return D.judged(_members(spark, sf), C).select("flow_key", "ep", "censored")


@query("WITH " + BASELINE_SQL + " SELECT corpus_start, corpus_end, margin_ms FROM stats")
def det_margin(spark, sf):
    return D.corpus_stats(_members(spark, sf), C)


@query("WITH " + BASELINE_SQL + " SELECT (SELECT count(*) FROM judged WHERE NOT censored) AS evaluated, (SELECT count(*) FROM judged WHERE censored) AS censored, (SELECT count(DISTINCT signature) FROM m) AS clusters, (SELECT count(DISTINCT signature) FROM m WHERE size < 10) AS under_sampled, (SELECT count(*) FROM m WHERE size < 10) AS skipped, corpus_start, corpus_end, margin_ms FROM stats")
def det_engine(spark, sf):
    return D.engine_counts(_members(spark, sf), C)


@query("WITH " + RANKING_SQL + " SELECT signature, type, index, site, expected, occurrences FROM dd")
def rank_dedupe(spark, sf):
    return R.dedupe(D.findings(_members(spark, sf), C)).select(*R.KEY, "occurrences")


@query("WITH " + RANKING_SQL + " SELECT signature, type, index, site, expected, r.thread_id AS thread_id, r.start_ms AS start_ms, r.raw_score AS raw_score FROM dd")
def rank_representative(spark, sf):
    return R.dedupe(D.findings(_members(spark, sf), C)).select(*R.KEY, "thread_id", "start_ms", "raw_score")


@query("WITH " + RANKING_SQL + " SELECT signature, type, index, site, expected, round(rarity, 9) AS rarity, severity, error_presence, round(magnitude, 9) AS magnitude, round(trust, 9) AS trust, variant_penalty, round(score, 9) AS score FROM so")
def rank_score(spark, sf):
    d = R.score(R.dedupe(D.findings(_members(spark, sf), C)), C)
    return d.select(*R.KEY, F.round("rarity", 9).alias("rarity"), "severity", "error_presence", F.round("magnitude", 9).alias("magnitude"), F.round("trust", 9).alias("trust"), "variant_penalty", F.round("score", 9).alias("score"))


@query("WITH " + RANKING_SQL + " SELECT signature, type, index, site, expected, suppressed, reason FROM su")
def rank_suppress(spark, sf):
    return R.suppress(R.dedupe(D.findings(_members(spark, sf), RULED)), RULED.suppressions).select(*R.KEY, "suppressed", "reason")


def _stored_findings(members: DataFrame) -> DataFrame:
    """Findings of ``clustered`` episodes, written once for all that read them."""
    return write_table(D.findings(members, RULED, stored=True), "findings")


def _ranking(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    found = _stored_findings(_members(spark, sf)) if found is None else found
    scored = R.score(R.dedupe(found), RULED).withColumn("score", F.round("score", 9))
    return R.ranked(cut_lineage(R.suppress(scored, RULED.suppressions)))


@query("WITH " + RANKING_SQL + " SELECT rank, signature, type, index, site, expected, occurrences, round(score, 9) AS score FROM rk WHERE rank <= 20")
def rank_topn(spark, sf):
    return _ranking(spark, sf).where(F.col("rank") <= C.top_n).select("rank", *R.KEY, "occurrences", "score")


_PROBES = ", ".join(f"('{i}', {1_704_067_200_000 + 7_919_000 * i})" for i in range(1, 150))


@query("WITH " + EPISODES_SQL + f""", q(flow_key, at_ms) AS (VALUES {_PROBES})
SELECT q.flow_key AS thread_id, q.at_ms, arg_min({{'ep': ep, 's': start_ms}}, {{'a': NOT (start_ms <= at_ms AND at_ms <= end_ms), 'b': CASE WHEN start_ms <= at_ms AND at_ms <= end_ms THEN start_ms ELSE abs(start_ms - at_ms) END, 'c': start_ms, 'd': ep}}).ep AS ep FROM q JOIN e USING (flow_key) GROUP BY ALL""")
def val_locate(spark, sf):
    probes = spark.createDataFrame([(str(i), 1_704_067_200_000 + 7_919_000 * i) for i in range(1, 150)], "thread_id string, at_ms bigint")
    return R.locate(_episodes(spark, sf), probes).select("thread_id", "at_ms", "ep")


_DEFECT_ROWS = ", ".join(f"('{d[0]}', '{d[1]}', {d[2]}, {d[3]}, {repr(d[4]) if d[4] else 'NULL'})" for d in DEFECTS)


@query("WITH " + RANKING_SQL + f""", q(id, flow_key, from_ms, to_ms, expected_site) AS (VALUES {_DEFECT_ROWS}),
c AS (SELECT q.id, f.site = q.expected_site AS here, rk.rank, rk.suppressed FROM q JOIN f ON f.flow_key = q.flow_key AND f.start_ms BETWEEN from_ms AND to_ms
  JOIN rk ON rk.signature = f.signature AND rk.type = f.type AND rk.index = f.index AND rk.site IS NOT DISTINCT FROM f.site AND rk.expected IS NOT DISTINCT FROM f.expected),
a AS (SELECT id, count(*) AS n, count(*) FILTER (here) AS k, min(rank) FILTER (here) AS r1, min(rank) AS r2, bool_or(suppressed) AS sup FROM c GROUP BY id),
b AS (SELECT q.id, expected_site, n, k, sup, CASE WHEN k > 0 THEN r1 ELSE r2 END AS best FROM q LEFT JOIN a USING (id))
SELECT id, best AS best_rank, coalesce(best <= 20, false) AS passed, best IS NOT NULL AND expected_site IS NOT NULL AND k = 0 AS elsewhere,
  CASE WHEN n IS NULL THEN 'not detected' WHEN best IS NULL AND sup THEN 'detected but suppressed' WHEN best IS NULL THEN 'detected but not ranked' WHEN best <= 20 THEN 'in top 20' ELSE 'ranked but below top 20' END AS note FROM b""")
def val_validate(spark, sf):
    defects = spark.createDataFrame(DEFECTS, "id string, thread_id string, from_ms bigint, to_ms bigint, expected_site string")
    found = _stored_findings(_members(spark, sf))
    return R.validate(found, _ranking(spark, sf, found), defects, C.top_n)
