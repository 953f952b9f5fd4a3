"""The input tables seen as evidence that the operators understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlens.config import FlowConfig
from emberlens.session import table

#: Half a day of silence ends an episode; a signup enters and a purchase completes a flow.
EVENTS_CONFIG = FlowConfig(idle_gap_ms=43_200_000, terminal_sites=("purchase",), entry_sites=("signup",), signature_k=2, min_cluster_size=10, timing_factor=1.2)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log records: a user is a thread, the event type a call site."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("thread_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("event_type").alias("call_site"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("props").alias("message"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("o1"),
        F.col("event_id").alias("o2"),
    )


#: CTEs of the same records, idle-gap episodes and runs in DuckDB.
RECORDS_SQL = """
r AS (SELECT user_id::VARCHAR AS flow_key, epoch_ns(ts) // 1000000 AS ts_ms, event_type AS call_site, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_id, props FROM events)"""
EPISODES_SQL = (
    RECORDS_SQL
    + """,
g AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY flow_key ORDER BY ts_ms, event_id) > 43200000 THEN 1 ELSE 0 END AS fresh FROM r),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY flow_key ORDER BY ts_ms, event_id)::BIGINT AS ep FROM g),
e AS (
  SELECT flow_key, ep, list(call_site ORDER BY ts_ms, event_id) AS seq, count(*) AS n_records, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, bool_or(level = 'ERROR') AS has_error,
         CASE WHEN bool_or(level = 'ERROR') THEN 'ERRORED' WHEN bool_or(call_site = 'purchase') THEN 'COMPLETED' ELSE 'TRUNCATED' END AS status FROM s GROUP BY ALL),
h AS (SELECT *, CASE WHEN call_site IS DISTINCT FROM lag(call_site) OVER (PARTITION BY flow_key, ep ORDER BY ts_ms, event_id) THEN 1 ELSE 0 END AS head FROM s),
runs AS (SELECT flow_key, ep, call_site AS site, ts_ms AS first_ms, row_number() OVER (PARTITION BY flow_key, ep ORDER BY ts_ms, event_id) - 1 AS pos FROM h WHERE head = 1),
p AS (SELECT flow_key, ep, string_agg(site, chr(1) ORDER BY pos) AS path, list(site ORDER BY pos) AS sites FROM runs GROUP BY ALL),
m0 AS (SELECT e.*, p.path, p.sites, array_to_string(seq[1:2], ' > ') AS signature FROM e JOIN p USING (flow_key, ep)),
m AS (SELECT *, count(*) OVER (PARTITION BY signature) AS size FROM m0)"""
)
BASELINE_SQL = (
    EPISODES_SQL
    + """,
pc AS (SELECT signature, path, any_value(sites) AS sites, count(*) AS n FROM m WHERE size >= 10 GROUP BY signature, path),
pr AS (SELECT *, sum(n) OVER (PARTITION BY signature)::BIGINT AS total, row_number() OVER (PARTITION BY signature ORDER BY n DESC, path) AS rank FROM pc),
modal AS (SELECT signature, sites AS modal, n AS modal_count, total, n / total AS modal_share FROM pr WHERE rank = 1),
op AS (
  SELECT m.signature, pos, site, count(*) AS n FROM runs JOIN m USING (flow_key, ep) JOIN modal ON m.signature = modal.signature WHERE pos < len(modal) GROUP BY ALL),
options AS (SELECT *, n / sum(n) OVER (PARTITION BY signature, pos) AS share, row_number() OVER (PARTITION BY signature, pos ORDER BY n DESC, site) AS rank FROM op),
steps AS (
  SELECT m.*, a.site AS src, b.site AS dst, b.pos AS index, greatest(b.first_ms - a.first_ms, 0) AS elapsed_ms
  FROM runs a JOIN runs b ON a.flow_key = b.flow_key AND a.ep = b.ep AND b.pos = a.pos + 1 JOIN m ON m.flow_key = a.flow_key AND m.ep = a.ep),
timing AS (
  SELECT signature, src, dst, count(*) AS n, quantile_disc(elapsed_ms, 0.5) AS p50_ms, quantile_disc(elapsed_ms, 0.95) AS p95_ms FROM steps WHERE size >= 10 GROUP BY signature, src, dst),
stats AS (SELECT min(start_ms) AS corpus_start, max(end_ms) AS corpus_end, quantile_disc(end_ms - start_ms, 0.99) AS margin_ms FROM m),
judged AS (
  SELECT m.*, modal.modal, modal_share, status <> 'COMPLETED' AND (start_ms <= corpus_start + margin_ms OR end_ms >= corpus_end - margin_ms) AS censored
  FROM m JOIN modal ON m.signature = modal.signature, stats WHERE size >= 10),
j AS (
  SELECT *, coalesce(list_min([i FOR i IN range(1, least(len(sites), len(modal)) + 1) IF sites[i] <> modal[i]]) - 1, least(len(sites), len(modal))) AS pre FROM judged WHERE NOT censored),
ft AS (
  SELECT flow_key, ep, start_ms, status, has_error, signature, size, 'TRUNCATION' AS type, sites[-1] AS site, len(sites) - 1 AS index, modal[-1] AS expected, modal_share AS expected_share, status AS observed,
         (len(modal) - pre) / len(modal) AS raw_score FROM j WHERE status <> 'COMPLETED' OR sites[-1] <> modal[-1]),
fd AS (
  SELECT flow_key, ep, start_ms, status, has_error, j.signature, size, 'DIVERGENCE', sites[pre + 1], pre, coalesce(o.site, '<end-of-flow>'), coalesce(o.share, modal_share), sites[pre + 1], coalesce(o.share, modal_share)
  FROM j LEFT JOIN options o ON o.signature = j.signature AND o.pos = pre AND o.rank = 1 WHERE pre < len(sites)),
fg AS (
  SELECT s.flow_key, s.ep, s.start_ms, s.status, s.has_error, s.signature, s.size, 'TIMING', s.dst, s.index, s.src, 0.0, printf('elapsed=%dms p95=%dms (%.1fx)', s.elapsed_ms, p95_ms, s.elapsed_ms / p95_ms), s.elapsed_ms / p95_ms
  FROM steps s JOIN j ON s.flow_key = j.flow_key AND s.ep = j.ep JOIN timing t ON t.signature = s.signature AND t.src = s.src AND t.dst = s.dst WHERE p95_ms > 0 AND s.elapsed_ms > p95_ms * 1.2),
f AS (SELECT * FROM ft UNION ALL SELECT * FROM fd UNION ALL SELECT * FROM fg)"""
)
RANKING_SQL = (
    BASELINE_SQL
    + """,
dd AS (
  SELECT signature, type, index, site, expected, count(*) AS occurrences,
         arg_min({'thread_id': flow_key, 'start_ms': start_ms, 'status': status, 'has_error': has_error, 'raw_score': raw_score, 'size': size}, {'a': -raw_score, 'b': flow_key, 'c': start_ms, 'd': ep}) AS r FROM f GROUP BY ALL),
sc AS (
  SELECT signature, type, index, site, expected, occurrences, r.thread_id AS thread_id, r.start_ms AS start_ms, r.raw_score AS raw_score, r.size AS size,
    least(greatest(1.0::DOUBLE - occurrences / r.size, 0.0), 1.0) AS rarity, CASE type WHEN 'TRUNCATION' THEN 1.0::DOUBLE WHEN 'DIVERGENCE' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS severity,
    CASE WHEN r.has_error THEN 1.0::DOUBLE ELSE 0.0 END AS error_presence, CASE WHEN type = 'TIMING' THEN least(log10(greatest(r.raw_score, 1.0)) / 2.0::DOUBLE, 1.0) ELSE 0.0::DOUBLE END AS magnitude,
    least(log10(r.size::DOUBLE) / 3.0::DOUBLE, 1.0) AS trust, CASE WHEN type = 'DIVERGENCE' AND r.status = 'COMPLETED' AND NOT r.has_error THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS variant_penalty FROM dd),
so AS (SELECT *, variant_penalty * (rarity + severity + 0.5::DOUBLE * error_presence + 0.5::DOUBLE * magnitude + 0.5::DOUBLE * trust) AS score FROM sc),
su AS (SELECT *, type = 'DIVERGENCE' AND coalesce(site = 'click', false) OR signature = 'view > view' AS suppressed,
       CASE WHEN type = 'DIVERGENCE' AND coalesce(site = 'click', false) THEN 'known variant' WHEN signature = 'view > view' THEN 'browsing' END AS reason FROM so),
rk AS (SELECT *, CASE WHEN NOT suppressed THEN row_number() OVER (PARTITION BY suppressed ORDER BY round(score, 9) DESC, signature, coalesce(site, ''), index, thread_id, start_ms, type, coalesce(expected, '')) END AS rank FROM su)"""
)
