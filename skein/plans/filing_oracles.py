"""DuckDB SQL for the chunks of filings: state machines as recursive queries over numbered rows.

They keep what the rules speak of (the open paragraphs, the cells of a table, the text
that waits) from row to row, unlike the engine, which sums over windows and arrays.
"""

from __future__ import annotations

from html.entities import html5

from skein.functions import rules
from skein.plans.oracles import B, BLOCKS, ORACLES, _case, _heading, _secondary, any_of, cleaned, listed, oracle, q, spaces, strip, words
from skein.plans.oracles import _skip as _SKIP

LOWER, TARGET, HARD, SPLIT_FROM = 300, 1200, 1500, 450


def bound(x: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value of ``x``."""
    return f"list_transform([{x}], lambda {name}: {body})[1]"


def skipped(x: str) -> str:
    return bound(x, "text", _SKIP)


def untopic(x: str, topic: str) -> str:
    """Without ``topic :`` at its start."""
    tail = f"substr(ut, length({topic}) + 1)"
    return bound(strip(x), "ut", f"CASE WHEN lower(substr(ut, 1, length({topic}))) = lower({topic}) AND regexp_matches({tail}, '^\\s*:') THEN regexp_extract({tail}, '(?s)^\\s*:\\s*(.*)$', 1) ELSE ut END")


def under(x: str, topic: str) -> str:
    """``topic: text``, lines with single blanks."""
    lines = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda tl: {spaces('tl')}), chr(10))"
    return bound(lines, "wt", f"CASE WHEN starts_with(lower(wt), lower({topic})) THEN wt ELSE {topic} || ': ' || wt END")


def raw_title(title: str) -> str:
    without = f"regexp_replace({title}, '^Item\\s+\\d+[A-Z]?\\.\\s*', '')"
    return f"regexp_replace({strip(without)}, '[.:]+$', '')"


def topic_of(raw: str, low: str, section: str) -> str:
    """The topic by a title without its item number, ``low`` (title and text in small letters) and the section."""
    generic = f"CASE lower({raw}) " + " ".join(f"WHEN {q(n)} THEN {q(t)}" for n, t in rules.GENERIC_TITLES.items()) + " END"
    short = f"regexp_replace(regexp_replace(string_split_regex({raw}, {q(rules.TITLE_CUT)})[1], '{B}+', ' ', 'g'), '^[ .:\\-]+|[ .:\\-]+$', '', 'g')"
    seven = f"array_to_string(string_split({short}, ' ')[1:7], ' ')"
    return f"""CASE {_case(low, rules.PRIORITY_TOPICS)} WHEN {section} = {q(rules.MDA)} AND regexp_matches({low}, '\\bvar\\b') THEN 'Value-at-risk' {_case(low, rules.TOPIC_RULES)}
  WHEN {section} = {q(rules.RISK)} THEN CASE {_case(low, rules.RISK_TOPICS)} ELSE 'Risk factor' END ELSE coalesce({generic}, nullif({seven}, ''), {section}) END"""


def low_value(topic: str, text: str) -> str:
    starts = " OR ".join(f"starts_with(lower({text}), {q(s)})" for s in rules.LOW_VALUE_STARTS)
    return f"(lower({topic}) IN ({', '.join(q(t) for t in rules.LOW_VALUE_TOPICS)}) OR {starts} OR {any_of(f'lower({text})', rules.LOW_VALUE_CONTAINS)})"


def concise(topic: str, title: str) -> str:
    x = f"CASE WHEN {strip(topic)} <> '' THEN {strip(topic)} ELSE {strip(title)} END"
    x = f"regexp_replace(regexp_replace({x}, '{B}+', ' ', 'g'), '^[ .:\\-]+|[ .:\\-]+$', '', 'g')"
    return bound(x, "ct", f"CASE WHEN length(ct) <= 80 THEN ct ELSE regexp_replace(substr(ct, 1, 77), '{B}+$', '') || '...' END")


def labels(secondary: bool) -> str:
    """Taxonomy by ``low`` (the topic) and ``hay`` (topic, title and text)."""
    arms = []
    for section in rules.TAXONOMY:
        each = " ".join(f"WHEN {any_of('low' if where == 'topic' else 'hay', needles)} THEN {_secondary(second, 'hay') if secondary else q(first)}" for where, needles, first, second in rules.TAXONOMY[section])
        arms.append(f"WHEN section = {q(section)} THEN CASE {each} END" if section != rules.MDA else f"ELSE CASE {each} END")
    return "CASE " + " ".join(sorted(arms, key=lambda a: a.startswith("ELSE"))) + " END"


_length = "(coalesce(list_sum(list_transform(f.paras, lambda p: length(p))), 0) + len(f.paras) - 1)"
_over = f"(len(f.paras) > 0 AND {_length} + 1 + length(s.clean) > {TARGET} AND {_length} >= {SPLIT_FROM})"
_form = lambda x: f"CASE WHEN length({x}) <= 180 THEN {x} ELSE regexp_replace(substr({x}, 1, 177), '{B}+$', '') || '...' END"

SECTION_CHUNKS = f"""{BLOCKS}, {cleaned("blocks", "doc, ordinal, section", "text", "c")},
  flagged AS (SELECT doc, section, ordinal, (ordinal // 10) % 3 = 1 AS in_table, x AS clean, {skipped("text")} AS skip, {skipped("x")} AS skip_clean, {_heading} AS heading FROM c JOIN (SELECT doc, ordinal, text FROM blocks) USING (doc, ordinal)),
  usable AS (SELECT *, NOT in_table AND NOT skip AND NOT skip_clean AND clean <> '' AS good FROM flagged),
  seq AS (SELECT doc, section, row_number() OVER (PARTITION BY doc ORDER BY ordinal) AS i, in_table, clean, skip, skip_clean, good AND heading AS head, good AND NOT heading AS para, false AS last FROM usable
    UNION ALL SELECT doc, section, count(*) + 1, false, '', true, true, false, false, true FROM usable GROUP BY doc, section),
  fold AS (SELECT DISTINCT doc, section, 0::BIGINT AS i, section AS title, []::VARCHAR[] AS paras, []::STRUCT(c VARCHAR, s BOOLEAN)[] AS cells, ''::VARCHAR AS of_title, NULL::STRUCT(c VARCHAR, s BOOLEAN)[] AS tab, NULL::VARCHAR[] AS txt FROM seq
    UNION ALL SELECT f.doc, f.section, s.i, CASE WHEN s.head THEN s.clean ELSE f.title END,
      CASE WHEN s.head THEN CASE WHEN f.section = {q(rules.RISK)} AND ends_with(s.clean, '.') THEN [s.clean] ELSE []::VARCHAR[] END WHEN s.para THEN CASE WHEN {_over} THEN [s.clean] ELSE list_append(f.paras, s.clean) END ELSE f.paras END,
      CASE WHEN NOT s.in_table THEN []::STRUCT(c VARCHAR, s BOOLEAN)[] WHEN s.skip THEN f.cells ELSE list_append(f.cells, {{'c': s.clean, 's': s.skip_clean}}) END,
      f.title, CASE WHEN NOT s.in_table THEN f.cells END, CASE WHEN s.head OR s.last OR (s.para AND {_over}) THEN f.paras END
    FROM fold f JOIN seq s ON s.doc = f.doc AND s.i = f.i + 1),
  sound AS (SELECT doc, section, i, of_title AS title, list_filter(tab, lambda c: NOT c.s AND c.c NOT IN ('', '$', '%', '-')) AS cs FROM fold WHERE len(tab) >= 8),
  cell AS (SELECT doc, section, i, title, unnest(cs).c AS c, unnest(range(1, len(cs) + 1)) AS n FROM sound),
  cut AS (SELECT *, {_form("c")} AS form, lag({_form("c")}, 1, '') OVER (PARTITION BY doc, i ORDER BY n) AS before FROM cell),
  compact AS (SELECT *, row_number() OVER (PARTITION BY doc, i ORDER BY n) AS place, sum(2 + length(form)) OVER (PARTITION BY doc, i ORDER BY n) - 2 AS upto FROM cut WHERE c <> before),
  tables AS (SELECT doc, section, i, title, string_agg(form, ' ' ORDER BY n) AS heard, string_agg(form, '; ' ORDER BY n) FILTER (WHERE place <= 35 AND upto <= {TARGET - 120}) AS body FROM compact GROUP BY ALL HAVING count(*) >= 8),
  made AS (SELECT doc, section, i, 0 AS k, 'table_summary' AS kind, title, NULL AS forced, heard, coalesce(body, '') AS body FROM tables
    UNION ALL SELECT doc, section, i, 1, 'text', of_title, NULL, array_to_string(txt, chr(10)), array_to_string(txt, chr(10)) FROM fold WHERE len(txt) > 0 AND NOT (of_title = 'Overview' AND len(txt) > 1)
    UNION ALL SELECT doc, section, i, 1, 'text', 'Overview', 'Firm business overview', '', txt[1] FROM fold WHERE of_title = 'Overview' AND len(txt) > 1
    UNION ALL SELECT doc, section, i, 2, 'text', 'Subsidiaries and structure', 'Subsidiaries and operating structure', '', array_to_string(txt[2:], chr(10)) FROM fold WHERE of_title = 'Overview' AND len(txt) > 1),
  named AS (SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY i, k)::INT AS number, {raw_title("title")} AS raw FROM made),
  heard AS (SELECT *, lower(raw || ' ' || heard) AS low FROM named),
  topics AS (SELECT *, coalesce(forced, {topic_of("raw", "low", "section")}) AS topic FROM heard),
  told AS (SELECT *, CASE WHEN kind = 'text' THEN body ELSE regexp_replace('Table summary for ' || topic || ': ' || body, '([^.])$', '\\1.') END AS said FROM topics),
  section_chunks AS (SELECT doc, section, number, kind, regexp_replace(title, '\\.+$', '') AS title, topic, CASE WHEN starts_with(lower(said), lower(topic)) THEN said ELSE topic || ': ' || said END AS text FROM told),
  kept AS (SELECT * FROM section_chunks WHERE kind = 'table_summary' OR {words("text")} >= 20)"""
oracle("section_chunks", SECTION_CHUNKS, "SELECT doc, section, number, kind, title, topic, text FROM kept")
ORACLES["section_chunks"] = ORACLES["section_chunks"].replace("WITH ", "WITH RECURSIVE ", 1)

_units = "list_filter(list_transform(string_split(regexp_replace(" + spaces("text") + ", '([.!?]) ([A-Z0-9\"''])', '\\1' || chr(10) || '\\2', 'g'), chr(10)), lambda u: " + strip("u") + "), lambda u: u <> '')"
_fits = lambda a, b: f"({a}.kind = 'text' AND {b}.kind = 'text' AND {a}.section = {b}.section AND {a}.topic = {b}.topic AND length({a}.text) + length({b}.text) <= {TARGET})"
_joined = lambda a, b: under(f"{a}.text || chr(10) || {untopic(f'{b}.text', f'{a}.topic')}", f"{a}.topic")
_packed = lambda p, text: f"{{'section': {p}.section, 'kind': {p}.kind, 'title': {p}.title, 'topic': {p}.topic, 'text': {text}}}"
_ahead = f"coalesce({_fits('f.waiting', 's.part')}, false)"
_now = f"CASE WHEN {_ahead} THEN {_joined('f.waiting', 's.part')} ELSE s.part.text END"
_last = f"CASE WHEN f.waiting IS NOT NULL AND NOT {_ahead} AND coalesce({_fits('f.last', 'f.waiting')}, false) THEN {_packed('f.last', _joined('f.last', 'f.waiting'))} ELSE f.last END"
_key = "CASE section " + " ".join(f"WHEN {q(n)} THEN {q(k)}" for n, k in rules.SECTION_KEYS.items()) + " END"
_part = "STRUCT(section VARCHAR, kind VARCHAR, title VARCHAR, topic VARCHAR, text VARCHAR)"

FILING_CHUNKS = f"""{SECTION_CHUNKS}, {cleaned("kept", "doc, section, number", "text", "k")},
  again AS (SELECT doc, section, number, kind, title, topic AS old, CASE WHEN kind = 'text' THEN k.x ELSE kept.text END AS text, {raw_title("title")} AS raw FROM kept JOIN k USING (doc, section, number)),
  lowered AS (SELECT *, lower(raw || ' ' || text) AS low FROM again),
  retold AS (SELECT *, CASE WHEN kind = 'text' THEN {topic_of("raw", "low", "section")} ELSE old END AS topic FROM lowered),
  good AS (SELECT * FROM retold WHERE kind = 'table_summary' OR NOT ({low_value("topic", "text")} OR ({words("text")} < 35 AND length(text) < {LOWER}))),
  long AS (SELECT *, {_units} AS units FROM good WHERE kind = 'text' AND length(text) > {HARD}),
  unit AS (SELECT doc, number, topic, unnest(units) AS u, unnest(range(1, len(units) + 1)) AS i FROM long),
  packing AS (SELECT DISTINCT doc, number, topic, 0::BIGINT AS i, ''::VARCHAR AS u, 0::BIGINT AS g, 0::BIGINT AS n, false AS closed FROM unit
    UNION ALL SELECT p.doc, p.number, p.topic, t.i, t.u, CASE WHEN b THEN p.g + 1 ELSE p.g END, CASE WHEN b THEN 0 ELSE p.n + 1 END + length({untopic("t.u", "p.topic")}), length(t.u) > {HARD}
    FROM packing p JOIN unit t ON t.doc = p.doc AND t.number = p.number AND t.i = p.i + 1, LATERAL (SELECT p.i = 0 OR p.closed OR length(t.u) > {HARD} OR (p.n + 1 + length(t.u) > {TARGET} AND p.n >= {LOWER}) AS b)),
  groups AS (SELECT doc, number, topic, g, string_agg({untopic("u", "topic")}, chr(10) ORDER BY i) AS t FROM packing WHERE i > 0 GROUP BY ALL),
  split AS (SELECT doc, number, g, {under(strip("t"), "topic")} AS text FROM groups WHERE {strip("t")} <> ''),
  parts AS (SELECT doc, section, number, 0 AS g, kind, title, topic, text FROM good WHERE NOT (kind = 'text' AND length(text) > {HARD})
    UNION ALL SELECT l.doc, l.section, l.number, s.g, l.kind, l.title, l.topic, s.text FROM long l JOIN split s ON s.doc = l.doc AND s.number = l.number),
  line AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY list_position({listed(rules.SECTIONS)}, section), number, g) AS i, {_packed("parts", "parts.text")} AS part FROM parts
    UNION ALL SELECT doc, count(*) + 1, {{'section': '', 'kind': 'end', 'title': '', 'topic': '', 'text': ''}} FROM parts GROUP BY doc),
  merging AS (SELECT DISTINCT doc, 0::BIGINT AS i, NULL::{_part} AS waiting, NULL::{_part} AS last, NULL::{_part} AS done FROM line
    UNION ALL SELECT f.doc, s.i, CASE WHEN short THEN now END, CASE WHEN short THEN lasting ELSE now END, CASE WHEN NOT short THEN lasting END
    FROM merging f JOIN line s ON s.doc = f.doc AND s.i = f.i + 1, LATERAL (SELECT {_packed("s.part", _now)} AS now, {_last} AS lasting), LATERAL (SELECT now.kind = 'text' AND length(now.text) < {LOWER} AS short)),
  final AS (SELECT doc, i AS place, done.section AS section, done.kind AS kind, done.title AS title, done.topic AS topic, done.text AS text FROM merging WHERE done IS NOT NULL),
  whole AS (SELECT * FROM final WHERE kind = 'table_summary' OR length(text) >= 150 OR {words("text")} >= 35),
  hays AS (SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY place) AS n, lower(topic) AS low, lower(topic || ' ' || title || ' ' || text) AS hay FROM whole)"""
_quality = f"CASE WHEN kind = 'table_summary' THEN CASE WHEN length(text) BETWEEN 300 AND 1200 THEN 'high' ELSE 'medium' END WHEN length(text) BETWEEN 300 AND 1200 AND {words('text')} >= 35 THEN 'high' WHEN length(text) BETWEEN 150 AND 1500 THEN 'medium' ELSE 'low' END"
oracle(
    "filing_chunks", FILING_CHUNKS,
    f"SELECT doc, doc || '_' || {_key} || '_' || lpad(n::VARCHAR, 4, '0') AS id, section, {labels(False)} AS primary_topic, {labels(True)} AS secondary_topic, kind AS chunk_type, {_quality} AS quality, {concise('topic', 'title')} AS title, text FROM hays",
)
ORACLES["filing_chunks"] = ORACLES["filing_chunks"].replace("WITH ", "WITH RECURSIVE ", 1)

# --- Blocks of HTML: a reader with a stack of what hides, token by token. ---
_inside = r"""(?:[^"'>]|"[^"]*"|'[^']*')*"""
_TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<script\b{_inside}>.*?(?:</script\b[^>]*>|\z)|<style\b{_inside}>.*?(?:</style\b[^>]*>|\z)|</?[a-z]{_inside}>|<[!?/][^>]*>|[^<]+|<"
_VOID = "'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr'"
_BREAKING = "'div', 'p', 'tr', 'li', 'br', 'hr'"
_names = "MAP {" + ", ".join(f"{q('&' + n)}: {q(c)}" for n, c in html5.items() if n.endswith(";")) + "}"
_plain = f"translate(array_to_string(list_transform(regexp_extract_all(t, '&[A-Za-z0-9]+;|[^&]+|&'), lambda p: coalesce({_names}[p], p)), ''), chr(160), ' ')"


def _attribute(name: str) -> str:
    """The value of an attribute of the tag t, small letters."""
    pattern = rf"""(?i)[^a-z-]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    return f"lower(trim(coalesce(regexp_extract(t, {q(pattern)}, 1), ''), {q(chr(34) + chr(39))}))"


_top = "coalesce(f.stack[-1], false)"

HTML_BLOCKS = f"""found AS (SELECT page_id, regexp_extract_all(html, {q(_TOKEN)}) AS ts FROM pages),
  each AS (SELECT page_id, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM found),
  read AS (SELECT *, lower(regexp_extract(t, '^</?([A-Za-z][^\\s/>]*)', 1)) AS name, starts_with(t, '</') AS ends, NOT regexp_matches(t, '^<[A-Za-z/!?]') AS is_text FROM each WHERE NOT regexp_matches(t, '(?i)^<(?:!|\\?|script\\b|style\\b)')),
  tok AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i, name, CASE WHEN is_text THEN 'text' WHEN name = '' THEN 'none' WHEN ends THEN CASE WHEN name IN ({_VOID}) THEN 'none' ELSE 'end' END WHEN name IN ({_VOID}) THEN 'void' WHEN ends_with(t, '/>') THEN 'both' ELSE 'start' END AS kind,
      CASE WHEN is_text THEN {_plain} END AS said, name = 'head' OR {_attribute("hidden")} IN ('hidden', 'true') OR contains(replace({_attribute("style")}, ' ', ''), 'display:none') AS own FROM read
    UNION ALL SELECT page_id, count(*) + 1, 'p', 'last', NULL, false FROM read GROUP BY page_id),
  walk AS (SELECT DISTINCT page_id, 0::BIGINT AS i, []::BOOLEAN[] AS stack, 0 AS tables, []::VARCHAR[] AS parts, false AS tab, NULL::VARCHAR[] AS out, false AS out_tab FROM tok
    UNION ALL SELECT f.page_id, k.i, CASE k.kind WHEN 'start' THEN list_append(f.stack, unseen) WHEN 'end' THEN f.stack[1:len(f.stack) - 1] ELSE f.stack END,
      CASE WHEN unseen OR k.name <> 'table' THEN f.tables WHEN k.kind = 'start' THEN f.tables + 1 WHEN k.kind = 'end' AND f.tables > 0 THEN f.tables - 1 ELSE f.tables END,
      CASE WHEN breaks THEN []::VARCHAR[] WHEN spoken THEN list_append(f.parts, k.said) ELSE f.parts END,
      CASE WHEN breaks THEN false WHEN spoken THEN f.tab OR f.tables > 0 ELSE f.tab END, CASE WHEN breaks THEN f.parts END, f.tab
    FROM walk f JOIN tok k ON k.page_id = f.page_id AND k.i = f.i + 1,
      LATERAL (SELECT {_top} OR (k.kind IN ('start', 'void', 'both') AND k.own) AS unseen),
      LATERAL (SELECT k.kind = 'last' OR (NOT unseen AND ((k.kind IN ('start', 'void', 'both') AND k.name IN ({_BREAKING})) OR (k.kind IN ('end', 'both') AND k.name IN ({_BREAKING}, 'td', 'th')))) AS breaks),
      LATERAL (SELECT k.kind = 'text' AND NOT unseen AND {strip("k.said")} <> '' AS spoken)),
  raw AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS ordinal, {spaces("array_to_string(out, ' ')")} AS text, out_tab AS in_table FROM walk WHERE len(out) > 0)"""
oracle("html_blocks", HTML_BLOCKS, "SELECT page_id, ordinal, text, in_table FROM raw WHERE text <> ''")
ORACLES["html_blocks"] = ORACLES["html_blocks"].replace("WITH ", "WITH RECURSIVE ", 1)

_first = lambda where: f"(SELECT min(b.ordinal) FROM shown b WHERE b.page_id = p.page_id AND {where})"
ORACLES["page_sections"] = f"""WITH RECURSIVE {HTML_BLOCKS}, shown AS (SELECT *, lead(text) OVER (PARTITION BY page_id ORDER BY ordinal) AS following FROM raw WHERE text <> ''), p AS (SELECT DISTINCT page_id FROM shown),
  a AS (SELECT page_id, {_first("ends_with(b.text, '.')")} AS s FROM p), a2 AS (SELECT page_id, s, {_first("b.ordinal > p.s AND NOT contains(b.text, '.')")} AS e FROM a p),
  r AS (SELECT page_id, {_first("b.ordinal >= p.e AND NOT contains(b.text, '.')")} AS s FROM a2 p WHERE e IS NOT NULL), r2 AS (SELECT page_id, s, {_first("b.ordinal > p.s AND contains(b.text, '©')")} AS e FROM r p),
  t AS (SELECT page_id, {_first("NOT contains(b.text, '.') AND NOT contains(b.text, '©') AND starts_with(b.following, 'A')")} AS s FROM p), t2 AS (SELECT page_id, s, {_first("b.ordinal > p.s AND contains(b.text, '©')")} AS e FROM t p),
  bounds AS (SELECT page_id, 'text' AS section, s, e FROM a2 UNION ALL SELECT page_id, 'rest', s, e FROM r2 UNION ALL SELECT page_id, 'titled', s, e FROM t2)
SELECT page_id, section, min(ordinal) AS first, max(ordinal) AS last, count(*) AS blocks FROM bounds JOIN shown USING (page_id) WHERE ordinal >= s AND ordinal < e GROUP BY 1, 2"""
