"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op2_url_reputation"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') AS path FROM u),
d AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM h),
v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rv FROM d),
hosts AS (
  SELECT host, count(rv) AS n, count(*) FILTER (rv = 'block') AS b,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_last(string_split(host, '.')) AS suffix FROM v GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY ALL),
whole AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(b), 0) AS b FROM suffixes),
pairs AS (
  SELECT 1 AS lv, s.n, s.b, w.n AS pn, w.b AS pb FROM suffixes s, whole w WHERE s.n > 0 AND w.n > 0
  UNION ALL SELECT 2, d.n, d.b, s.n, s.b FROM domains d JOIN suffixes s USING (suffix) WHERE d.n > 0 AND s.n > 0
  UNION ALL SELECT 3, h.n, h.b, d.n, d.b FROM hosts h JOIN domains d USING (domain, suffix) WHERE h.n > 0 AND d.n > 0),
m AS (
  SELECT lv, count(*)::DOUBLE AS g, sum(n / pn) AS parents, sum(n)::DOUBLE AS total, sum(n * pow(b / n - pb / pn, 2)) AS between_,
         sum(n * (pb / pn) * (1 - pb / pn)) AS within_, sum(n / pn * n) AS own FROM pairs GROUP BY lv),
r AS (SELECT lv, (between_ - (g - parents) * within_ / total) / nullif(within_ / total * (total - own - (g - parents)), 0) AS rho FROM m),
k AS (SELECT lv, CASE WHEN rho > 0 THEN least(greatest((1 - rho) / rho, 1.0), 10000.0) ELSE 10000.0 END AS kappa FROM r),
kk AS (
  SELECT coalesce(max(kappa) FILTER (lv = 1), 10000.0) AS k1, coalesce(max(kappa) FILTER (lv = 2), 10000.0) AS k2, coalesce(max(kappa) FILTER (lv = 3), 10000.0) AS k3 FROM k),
s1 AS (SELECT suffix, (s.b + k1 * ((w.b + 1) / (w.n + 2))) / (s.n + k1) AS p FROM suffixes s, whole w, kk),
d1 AS (SELECT domain, suffix, (d.b + k2 * p) / (d.n + k2) AS p FROM domains d JOIN s1 USING (suffix), kk),
h1 AS (SELECT host, h.n, h.b, k3, (h.b + k3 * p) / (h.n + k3) AS rate FROM hosts h JOIN d1 USING (domain, suffix), kk),
h2 AS (SELECT host, n, b, rate - 1.645 * sqrt(rate * (1 - rate) / (n + k3 + 1)) AS low FROM h1)
SELECT page_id, v.host, path, rule, coalesce(rv, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       n AS n_labelled, b AS n_blocked, round(low, 6) AS rate_low
FROM v LEFT JOIN h2 USING (host)"""

_RUNS = r"""
  SELECT doc_id, text, {kind} AS kind, {name} AS name, i, string_split_regex(text, '{pat}') AS gaps, regexp_extract_all(text, '{pat}') AS hits, regexp_extract_all(text, '{pat}', {group}) AS keys, {least} AS least
  FROM d WHERE regexp_matches(text, '{pat}')"""
_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = [
    ("assign", _ASSIGN, 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s{0,4}(?:(?:Proc-Type|DEK-Info): [\x20-\x7E]{0,200}\s{1,4}){0,2}[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    # group 1 is the span, behind what can't stand in a token
    ("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1),
    ("hosttoken", "(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})", 0, 1),
]
SQL["op5_secret_ledger"] = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS i FROM documents), runs AS ("
    + " UNION ALL ".join(_RUNS.format(kind=k, name=f"'{name}'", pat=pat, group=g, least=least) for k, (name, pat, g, least) in enumerate(_SECRETS))
    + r"""),
pieces AS (SELECT i, kind, name, least, gaps, hits, keys, unnest(range(1, len(hits) + 1)) AS j FROM runs),
spans AS (
  SELECT i, kind, name, list_sum(list_transform(gaps[1:j], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:j-1], lambda x: length(x))), 0)::BIGINT + CASE kind WHEN 4 THEN length(hits[j]) - length(keys[j]) ELSE 0 END AS start, length(CASE kind WHEN 4 THEN keys[j] ELSE hits[j] END) AS n
  FROM pieces WHERE length(keys[j]) >= least),
found AS (
  SELECT i, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(name || ':' || start || ':' || (start + n), ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base,
    string_agg(name || ':' || start || ':' || (start + n), ',' ORDER BY start, kind) AS spans FROM spans GROUP BY i)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (i)"""
)

SQL["op8_source_mix"] = r"""
WITH RECURSIVE q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / (CASE quality WHEN 1 THEN 3.0::DOUBLE WHEN 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) AS key
  FROM documents LEFT JOIN q USING (doc_id)),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT source, source_size, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s0),
level AS (
  SELECT 0 AS step, list({'source': source, 'cap': cap, 'weight': weight, 'full': false}) AS open, (SELECT sum(source_size)::BIGINT FROM s1) AS total,
         ((SELECT sum(source_size) FROM s1)::BIGINT / (SELECT sum(weight) FROM s1)::BIGINT)::DOUBLE AS lv, true AS more FROM s1
  UNION ALL
  SELECT step + 1, kept, total,
         (total - coalesce(list_sum(list_transform(list_filter(kept, lambda x: x.full), lambda x: x.cap)), 0)::BIGINT) / nullif(list_sum(list_transform(list_filter(kept, lambda x: NOT x.full), lambda x: x.weight)), 0)::BIGINT,
         len(list_filter(kept, lambda x: x.full)) > len(list_filter(open, lambda x: x.full))
  FROM (SELECT step, total, open, list_transform(open, lambda x: {'source': x.source, 'cap': x.cap, 'weight': x.weight, 'full': x.full OR x.cap < lv * x.weight}) AS kept FROM level WHERE more AND step < 100)),
final AS (SELECT lv FROM level ORDER BY step DESC LIMIT 1),
s2 AS (SELECT source, source_size, CASE WHEN cap < coalesce(lv, 0) * weight THEN cap::DOUBLE ELSE coalesce(lv, 0) * weight END AS target FROM s1, final),
s3 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS rounds FROM s2),
s4 AS (SELECT *, greatest(floor(target)::BIGINT - rounds * source_size, 0) AS rest FROM s3),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS ahead FROM d)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(least(rest - ahead, size), 0))::BIGINT AS taken, p.source AS source
FROM p JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source"""

SQL["op9_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, 10 + length(role) + len(regexp_extract_all(role, '[\\<#:]')) + 2 + length(text) + len(regexp_extract_all(text, '[\\<#]')) + 8 AS chars FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars,
         string_agg(role, ' ' ORDER BY turn, role, text) AS roles FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       regexp_full_match(roles, '(system )?user( assistant user)*( assistant)?') AS valid FROM g"""

SQL["op4_decontaminate"] = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS words FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT kind, id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
s AS (SELECT DISTINCT kind, id, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS g FROM p),
n AS (SELECT id AS item_id, count(*) AS n_item_shingles FROM s WHERE kind = 'i' GROUP BY id),
m AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i USING (g) WHERE d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment FROM m JOIN n USING (item_id)
WHERE n_shared * 1000 >= n_item_shingles * 800"""

SQL["op7_impact_search"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def _vector_codes(rounds: int = 6) -> str:
    """Lloyd's rounds unrolled, one row for each component."""
    d2 = "sum((x.v - c.v) * (x.v - c.v))"
    near = "SELECT x.i, x.p, c.e, {d2} AS d FROM x JOIN c{r} c USING (p, j) GROUP BY ALL"
    sql = """
WITH k AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS i FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT i, (o - 1) // (n // 8) AS p, (o - 1) % (n // 8) AS j, v FROM (
    SELECT i, len(embedding) AS n, unnest(list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT)) AS v, unnest(range(1, len(embedding) + 1)) AS o FROM k)),
c0 AS MATERIALIZED (SELECT p, i - 1 AS e, j, v::HUGEINT AS v FROM x WHERE i <= 16)"""
    for r in range(rounds + 1):
        sql += f""",
n{r} AS ({near.format(d2=d2, r=r)}), a{r} AS MATERIALIZED (SELECT i, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM n{r} GROUP BY ALL)"""
        if r < rounds:
            sql += f""",
m{r} AS (SELECT p, e, j, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x JOIN a{r} USING (i, p) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT p, e, j, coalesce((s - ((s % n) + n) % n) // n, v) AS v FROM c{r} LEFT JOIN m{r} USING (p, e, j))"""
    return (
        sql
        + f""",
codes AS (SELECT i, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY i),
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN codes USING (i), books"""
    )


SQL["op11_vector_codes"] = _vector_codes()

SQL["op12_phrases"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
f1 AS MATERIALIZED (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest(w) AS phrase FROM p) GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM p) GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM p) GROUP BY ALL HAVING count(*) >= 10),
every AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3),
cuts AS (
  SELECT lang, phrase, 2 AS size, n AS a, 1 AS k, split_part(phrase, ' ', 1) AS head, split_part(phrase, ' ', 2) AS rest FROM f2
  UNION ALL SELECT lang, phrase, 3, n, 1, split_part(phrase, ' ', 1), split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) FROM f3
  UNION ALL SELECT lang, phrase, 3, n, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) FROM f3),
s AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, h.n AS l, t.n AS r, (1000000::HUGEINT * c.a * c.a) // (h.n::HUGEINT * t.n) AS score
  FROM cuts c JOIN every h ON h.lang = c.lang AND h.phrase = c.head JOIN every t ON t.lang = c.lang AND t.phrase = c.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS f FROM (
    SELECT lang, n AS a, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase FROM f3
    UNION ALL SELECT lang, n, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) FROM f3) GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE size = 3 OR f IS NULL OR 100 * f < 50 * a),
m AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM z JOIN m USING (lang) QUALIFY rank <= 2000"""

#: Checksums fold chunks of 64 bytes: the state is moved on by 64 bytes through four tables and meets the chunk's own sum.
_CRC = r"""
tab AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b::BIGINT] || [0,0,0,0,0,0,0,0]::BIGINT[], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(b))),
far AS (
  SELECT list(v ORDER BY k, b) AS f FROM (SELECT k, b, list_reduce([b::BIGINT << (8 * k)::INT] || list_transform(range(64), lambda i: 0::BIGINT), lambda a, x: xor(a >> 8, t[a % 256 + 1])) AS v FROM range(256) r(b), range(4) s(k), tab)),
raw AS (SELECT row_number() OVER () AS i, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (SELECT i, c, substr(h, (length(h) % 128 + 128 * (c - 1) + 1)::BIGINT, 128) AS h FROM (SELECT i, h, unnest(range(1, length(h) // 128 + 1)) AS c FROM raw)
  UNION ALL SELECT i, 0, substr(h, 1, length(h) % 128) FROM raw),
sums AS (
  SELECT i, c, list_reduce([CASE WHEN c = 0 THEN 4294967295 ELSE 0 END::BIGINT] || list_transform(range(1, length(h), 2), lambda j: (instr('0123456789ABCDEF', h[j]) - 1) * 16 + instr('0123456789ABCDEF', h[j + 1]) - 1), lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1])) AS v FROM chunks, tab),
crcs AS (
  SELECT i, xor(list_reduce(list(v ORDER BY c), lambda a, x: xor(x, xor(xor(f[a % 256 + 1], f[256 + (a >> 8) % 256 + 1]), xor(f[512 + (a >> 16) % 256 + 1], f[768 + (a >> 24) + 1])))), 4294967295) AS crc FROM sums, (SELECT f FROM far) GROUP BY i, f)"""
SQL["op13_hilbert_shards"] = (
    f"WITH {_CRC},"
    + r"""
d AS (SELECT raw.i, raw.doc_id, strlen(coalesce(text, '')) + 1 AS size, crc AS text_crc32, lang, source, n_chars
  FROM (SELECT row_number() OVER () AS i, * FROM documents) o JOIN raw USING (i) JOIN crcs USING (i)),
"""
    + ",\n".join(f"q{k} AS (SELECT {c} AS v, (coalesce(sum(count(*)) OVER (ORDER BY {c} NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT * 1024 // sum(count(*)) OVER ())::BIGINT AS cell FROM d GROUP BY {c})" for k, c in enumerate(("lang", "source", "n_chars")))
    + r""",
c AS (SELECT d.*, [q0.cell, q1.cell, q2.cell] AS x FROM d JOIN q0 ON q0.v IS NOT DISTINCT FROM d.lang JOIN q1 ON q1.v IS NOT DISTINCT FROM d.source JOIN q2 ON q2.v IS NOT DISTINCT FROM d.n_chars),
u AS (SELECT *, list_reduce([x] || flatten(list_transform(range(9), lambda b: list_transform(range(3), lambda k: [1 << (9 - b)::INT, k]))), lambda a, s:
    CASE WHEN a[s[2] + 1] & s[1] <> 0 THEN [xor(a[1], s[1] - 1), a[2], a[3]]
      WHEN s[2] = 0 THEN a
      WHEN s[2] = 1 THEN [xor(a[1], xor(a[1], a[2]) & (s[1] - 1)), xor(a[2], xor(a[1], a[2]) & (s[1] - 1)), a[3]]
      ELSE [xor(a[1], xor(a[1], a[3]) & (s[1] - 1)), a[2], xor(a[3], xor(a[1], a[3]) & (s[1] - 1))] END) AS y FROM c),
g AS (SELECT *, [y[1], xor(y[1], y[2]), xor(xor(y[1], y[2]), y[3])] AS w FROM u),
t AS (SELECT *, list_reduce([0::BIGINT] || list_transform(range(9), lambda b: 1::BIGINT << (9 - b)::INT), lambda a, b: CASE WHEN w[3] & b <> 0 THEN xor(a, b - 1) ELSE a END) AS t FROM g),
h AS (SELECT *, list_sum(list_transform(range(30), lambda k: ((xor(w[k % 3 + 1], t) >> (9 - k // 3)::INT) & 1) << (29 - k)::INT))::BIGINT AS curve FROM t),
z AS (SELECT *, row_number() OVER (ORDER BY curve, size, text_crc32, doc_id NULLS LAST) - 1 AS o, count(*) OVER () AS n FROM h),
s AS (SELECT *, o * 8 // n AS shard FROM z)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, o - (shard * n + 7) // 8 AS slot, NULL::INT AS grown_shard, curve FROM s"""
)
