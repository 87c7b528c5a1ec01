"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

_SIZES = f"""sized AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk, md5(coalesce(doc_id::VARCHAR, 'null')) AS place FROM documents),
  sources AS (SELECT sk, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY sk) - 1 AS r FROM sized GROUP BY 1),
  weighed AS (SELECT *, r % 3 + 1 AS w, CASE WHEN r % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS b FROM sources),
  filled AS (SELECT *, (sum(s) OVER () - coalesce(sum(3 * s) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level FROM weighed WINDOW f AS (ORDER BY 3 * s / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  targets AS (SELECT sk, s, b, least((3 * s)::DOUBLE, max(level) OVER () * w) AS target FROM filled),
  laid AS (SELECT doc_id, size, s, b, target, floor(target + 0.5)::BIGINT AS asked, coalesce(sum(size) OVER (PARTITION BY sk ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized JOIN targets USING (sk)),
  cut AS (SELECT *, CASE WHEN s > 0 THEN asked // s ELSE 0 END AS rounds FROM laid),
  parts AS (SELECT *, greatest(0, least(size, asked - rounds * s - before)) AS extra FROM cut),
  mixed AS (SELECT *, CASE WHEN size > 0 THEN rounds + CASE WHEN extra > 0 THEN 1 ELSE 0 END ELSE 0 END::INT AS copies FROM parts)"""

_MIX = f"""WITH {_SIZES}
SELECT doc_id, size, s AS source_size, target, (rounds * size + extra)::BIGINT AS taken, copies,
  CASE WHEN copies > 0 AND target > 0 THEN (sqrt((1 - b) * (1 - b) + 4 * b * (before / target)) - (1 - b)) / (2 * b) + 0.0 END AS position FROM mixed"""

_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", r"([0-9a-f]+)", 1, 32),
)


def _found(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""{kind}_m AS (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS kept FROM texts),
  {kind}_i AS (SELECT doc_id, gaps, hits, kept, unnest(range(1, len(hits) + 1)) AS i FROM {kind}_m),
  {kind}_s AS (SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start, length(hits[i]) AS n FROM {kind}_i WHERE length(kept[i]) >= {least})"""


_SECRETS = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  {", ".join(_found(i, *r) for i, r in enumerate(_RULES))},
  spans AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s),
  per AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS k, count(*) FILTER (WHERE rank = 2) AS h, string_agg(kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN per USING (doc_id)"""

_JOIN = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
  grams AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
  shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM grams),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
  shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)),
  both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.y) AS component_id FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY 1, 2"""

_PASSAGES = f"""WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
  starts AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM words WHERE len(w) >= 50),
  stretches AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 50], ' ') AS s FROM starts),
  shared AS (SELECT s, min(doc_id) AS a, max(doc_id) AS z FROM stretches GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
  places AS (SELECT doc_id, i, min(a) AS a, max(z) AS z FROM stretches JOIN shared USING (s) GROUP BY 1, 2),
  marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM places),
  parts AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM marked),
  merged AS (SELECT doc_id, min(i) AS i, max(i) + 50 AS j, min(a) AS a, max(z) AS z FROM parts GROUP BY doc_id, part)
SELECT doc_id, i::INT AS start_word, j::INT AS end_word, (j - i)::INT AS n_words, CASE WHEN a <> doc_id THEN a ELSE z END AS other_doc FROM merged"""

_ALNUM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Every alignment of a document and an item that agrees anywhere, without seeds.
_LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{_ALNUM}') AS w FROM documents WHERE text IS NOT NULL),
  t AS (SELECT item_id, regexp_extract_all(lower(text), '{_ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL),
  dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
  tw AS (SELECT item_id, least(16, len(w)) AS n_window, unnest(w) AS word, unnest(range(0, len(w))) AS j FROM t WHERE len(w) >= 6),
  agreeing AS (SELECT doc_id, item_id, n_window, i - j AS lag, i FROM dw JOIN tw USING (word)),
  near AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, lag ORDER BY i RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS n_equal FROM agreeing),
  best AS (SELECT *, greatest(lag, 0) AS doc_at, greatest(-lag, 0) AS item_at, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, greatest(lag, 0), greatest(-lag, 0)) AS r FROM near WHERE n_equal >= ceil(0.75 * n_window))
SELECT doc_id, item_id, n_equal::INT AS n_equal, n_window::INT AS n_window, doc_at::INT AS doc_at, item_at::INT AS item_at FROM best WHERE r = 1"""


#: Checksums by a recursive query over the distinct texts: eight shifts for each character.
_SESSIONS = """WITH RECURSIVE turns AS (SELECT conv_id, turn FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
  texts AS (SELECT DISTINCT conv_id::VARCHAR AS t FROM turns UNION SELECT DISTINCT conv_id::VARCHAR || ':' || turn::VARCHAR FROM turns),
  sums AS (SELECT t, 0 AS i, 4294967295::BIGINT AS v FROM texts
    UNION ALL SELECT t, i + 1, CASE WHEN i % 9 = 0 THEN xor(v, ascii(substr(t, i // 9 + 1, 1))::BIGINT) WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM sums WHERE i < 9 * length(t)),
  crc AS (SELECT t, xor(v, 4294967295::BIGINT) AS crc FROM sums WHERE i = 9 * length(t)),
  timed AS (SELECT 2 * floor(conv_id / 8)::BIGINT + a.crc % 2 AS usr, (a.crc // 2) % 7200 + 300 * turn + b.crc % 600 AS s, b.crc // 600 AS g, b.crc AS h
    FROM turns JOIN crc a ON a.t = conv_id::VARCHAR JOIN crc b ON b.t = conv_id::VARCHAR || ':' || turn::VARCHAR),
  ev AS (SELECT usr, s, h, floor(s / 3600)::BIGINT + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS batch FROM timed),
  batches AS (SELECT DISTINCT batch AS now FROM ev),
  known AS (SELECT now, ev.*, CASE WHEN s - lag(s) OVER (PARTITION BY now, usr ORDER BY s) <= 420 THEN 0 ELSE 1 END AS new FROM batches JOIN ev ON batch <= now),
  parts AS (SELECT *, sum(new) OVER (PARTITION BY now, usr ORDER BY s) AS part FROM known),
  state AS (SELECT now, usr, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (WHERE batch = now) AS n_new, sum(h)::BIGINT AS h_sum FROM parts GROUP BY now, usr, part),
  version AS (SELECT * FROM state WHERE n_new > 0),
  earlier AS (SELECT a.now, max(b.now) AS before FROM batches a JOIN batches b ON b.now < a.now GROUP BY 1),
  contained AS (SELECT v.usr, v.now, v.start_s, count(*) AS n FROM version v JOIN earlier e ON e.now = v.now JOIN state p ON p.now = e.before AND p.usr = v.usr AND p.start_s BETWEEN v.start_s AND v.end_s GROUP BY 1, 2, 3),
  gone AS (SELECT v.usr, v.now, v.start_s, min(w.now) AS later FROM version v JOIN version w ON w.usr = v.usr AND w.now > v.now AND v.start_s BETWEEN w.start_s AND w.end_s GROUP BY 1, 2, 3),
  by_whom AS (SELECT g.usr, g.now, g.start_s, g.later, w.start_s AS later_start FROM gone g JOIN version w ON w.usr = g.usr AND w.now = g.later AND g.start_s BETWEEN w.start_s AND w.end_s)
SELECT v.usr AS "user", v.now AS batch, v.start_s, v.end_s, v.n_events, v.n_new, coalesce(c.n, 0) AS n_retracted, v.h_sum, b.later AS retracted_batch, b.later_start AS retracted_start_s
FROM version v LEFT JOIN contained c USING (usr, now, start_s) LEFT JOIN by_whom b USING (usr, now, start_s)"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}')"

_SEARCH = f"""WITH held AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
  docs AS (SELECT r, doc_id, terms, len(terms) AS n FROM held WHERE len(terms) > 0),
  totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_all FROM docs),
  occurs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY 1, 2),
  weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM occurs, totals GROUP BY term, n_docs),
  measured AS (SELECT r, doc_id, 10 + (90 * n * n_docs) // n_all AS m FROM docs, totals),
  asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
  scored AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN weighed USING (term) JOIN occurs USING (term) JOIN measured USING (r) GROUP BY 1, 2, 3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

ORACLES = {"op1_suffix_dedup": _PASSAGES, "op5_decontaminate": _LEAKS, "op2_ngram_join": _JOIN, "op7_secret_ledger": _SECRETS, "op10_mix_curriculum": _MIX, "op11_lexical_search": _SEARCH, "op13_late_sessions": _SESSIONS}
