"""DuckDB SQL for the registered queries, written from the definitions, not from the Spark code."""

from __future__ import annotations

from skein.functions import rules
from skein.operators.answering import OUTPUT_FORMAT, SYSTEM
from skein.plans.tables import DATE, TOPICS

ORACLES: dict[str, str] = {}
B = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"


def lexical(x: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all(lower({x}), '[一-鿿]+|[A-Za-z0-9]+'), lambda r:
      CASE WHEN regexp_matches(r, '^[一-鿿]') THEN list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) ELSE [r] END))"""


def sentences(x: str) -> str:
    cut = f"string_split_regex(regexp_replace({x}, '([。！？!?；;])', '\\1' || chr(10), 'g'), '\\n+')"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"


def spaces(x: str) -> str:
    x = f"translate({x}, '’“”–—', '''\"\"--')"
    x = f"regexp_replace({x}, '{B}+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ([,.;:%)])', '\\1', 'g')"
    return strip(f"replace({x}, '( ', '(')")


def any_of(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-z0-9]+'))"


def listed(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]" if items else "[]::VARCHAR[]"


DOCS = f"docs AS (SELECT doc_id, {strip('substr(split_part(text, chr(10), 1), 1, 80)')} AS title, source, '{DATE}' AS date, lang AS category, text AS content FROM documents)"


def pieces(size: int = 500, overlap: int = 80) -> str:
    step = size - overlap
    return f"""{DOCS},
  bodies AS (SELECT doc_id, title, source, date, category, {strip("content")} AS body FROM docs),
  cuts AS (SELECT *, unnest(range(0, CASE WHEN length(body) = 0 THEN 0 WHEN length(body) <= {size} THEN 1 ELSE ((length(body) - {size} + {step - 1}) // {step}) + 1 END)) AS k FROM bodies),
  parts AS (SELECT doc_id, title, source, date, category, k, {strip(f"substr(body, k * {step} + 1, {size})")} AS text FROM cuts),
  pieces AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index FROM parts WHERE text <> '')"""


CHUNKS = f"""{pieces()},
  chunks AS (SELECT p.doc_id * 1048576 + chunk_index AS position, p.doc_id || '_chunk_' || chunk_index AS chunk_id, p.doc_id, title, source, date, chunk_index, text,
    {listed(rules.SECTIONS)}[(p.doc_id % 3 + 1)::INT] AS section, {listed(TOPICS)}[(p.doc_id % 8 + 1)::INT] AS primary_topic, '' AS secondary_topic,
    CASE l.q WHEN 1 THEN 'high' WHEN 0 THEN 'medium' ELSE 'low' END AS quality
    FROM pieces p LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l USING (doc_id)),
  embedded AS (SELECT position, concat_ws(chr(10), nullif(title, ''), section, primary_topic, 'text', quality, text) AS t FROM chunks)"""


def buckets(source: str, key: str, text: str, dim: int, name: str) -> str:
    return f"""{name}_tok AS (SELECT {key}, sha256(unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))) AS h FROM {source}),
  {name} AS (SELECT {key}, ('0x' || substr(h, 1, 8))::UBIGINT::BIGINT % {dim} AS bucket, sum(CASE WHEN substr(h, 10, 1) IN ('0','2','4','6','8','a','c','e') THEN 1 ELSE -1 END)::BIGINT AS value FROM {name}_tok GROUP BY 1, 2)"""


def unit(name: str, key: str) -> str:
    return f"{name}_u AS (SELECT {key}, bucket, value / sqrt(sum(value * value) OVER (PARTITION BY {key})) AS v FROM {name} WHERE value <> 0)"


def topk(k: int, dim: int = 256, questions: str = "SELECT item_id AS qid, text AS question FROM benchmark") -> str:
    return f"""{CHUNKS},
  questions AS ({questions}),
  {buckets("questions", "qid", "question", dim, "qb")}, {unit("qb", "qid")},
  {buckets("embedded", "position", "t", dim, "cb")}, {unit("cb", "position")},
  scored AS (SELECT qid, position, round(sum(a.v * b.v), 9) AS embedding_score FROM qb_u a JOIN cb_u b USING (bucket) GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY embedding_score DESC, position)::INT AS rank FROM scored),
  found AS (SELECT * FROM ranked WHERE rank <= {k})"""


def kind(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({x})', n)} THEN {q(k)}" for k, n in rules.QUERY_NEEDLES) + " ELSE 'general' END"


def section_bonus(section: str, k: str) -> str:
    table = lambda w: "CASE " + section + " " + " ".join(f"WHEN {q(s)} THEN {v}" for s, v in w.items()) + " ELSE 0.0 END"
    return f"(CASE WHEN {k} = 'risk' THEN {table(rules.SECTION_WEIGHTS['risk'])} WHEN {k} = 'business' THEN {table(rules.SECTION_WEIGHTS['business'])} WHEN {k} = 'general' OR {section} = {q(rules.MDA)} THEN 0.15 ELSE 0.0 END)::DOUBLE"


def topics_of(k: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} = {q(n)} THEN {listed(t)}" for n, t in rules.QUERY_TOPICS.items()) + " END"


def topic_bonus(k: str) -> str:
    return f"(CASE WHEN list_contains({topics_of(k)}, primary_topic) THEN 0.10 ELSE 0.0 END + CASE WHEN list_contains({topics_of(k)}, secondary_topic) THEN 0.05 ELSE 0.0 END)::DOUBLE"


QUALITY = "(CASE lower(quality) WHEN 'high' THEN 0.05 WHEN 'medium' THEN 0.02 ELSE 0.0 END)::DOUBLE"


def reranked(dim: int = 256, questions: str = "SELECT item_id AS qid, text AS question FROM benchmark") -> str:
    return f"""{topk(32, dim, questions)},
  typed AS (SELECT qid, {kind("question")} AS kind FROM questions),
  mixed AS (SELECT f.qid, c.*, embedding_score, round(0.7::DOUBLE * embedding_score + 0.15::DOUBLE * {section_bonus("section", "kind")} + 0.1::DOUBLE * {topic_bonus("kind")} + 0.05::DOUBLE * {QUALITY}, 9) AS score
    FROM found f JOIN chunks c USING (position) JOIN typed USING (qid)),
  placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, embedding_score DESC, position)::INT AS rank FROM mixed),
  retrieved AS (SELECT * FROM placed WHERE rank <= 4)"""


def context(dim: int = 256, questions: str = "SELECT item_id AS qid, text AS question FROM benchmark") -> str:
    return f"""{reranked(dim, questions)},
  near AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM retrieved),
  context AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS context_rank FROM near WHERE score >= CASE WHEN best > 0 THEN round(best * 0.78::DOUBLE, 9) ELSE best END)"""


def scored_sentences(dim: int = 256, questions: str = "SELECT item_id AS qid, text AS question FROM benchmark") -> str:
    return f"""{context(dim, questions)},
  terms AS (SELECT qid, list_filter(list_distinct({lexical("question")}), lambda t: NOT list_contains({listed(rules.STOP_WORDS)}, t)) AS terms FROM questions),
  said AS (SELECT qid, context_rank, title, source, date, terms, len(list_intersect(list_distinct({lexical("concat_ws(' ', title, section, primary_topic, secondary_topic)")}), terms)) AS meta, {sentences("text")} AS ss FROM context JOIN terms USING (qid)),
  lines AS (SELECT qid, context_rank, title, source, date, terms, meta, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS sentence_no FROM said),
  hits AS (SELECT *, len(list_intersect(list_distinct({lexical("sentence")}), terms)) AS n FROM lines),
  sentence_scores AS (SELECT *, round(CASE WHEN len(terms) = 0 OR (n = 0 AND meta = 0) THEN 0.0 ELSE greatest(0.0::DOUBLE, (n + 0.25::DOUBLE * meta) / greatest(len(terms), 1) - least(greatest(length(sentence) - 700, 0) * 0.0004::DOUBLE, 0.25::DOUBLE)) END
    + greatest(0.0::DOUBLE, 0.05::DOUBLE - (context_rank - 1) * 0.01::DOUBLE), 9) AS score FROM hits)"""


def top_sentences(dim: int = 256, questions: str = "SELECT item_id AS qid, text AS question FROM benchmark") -> str:
    return f"""{scored_sentences(dim, questions)},
  floors AS (SELECT *, greatest(0.12::DOUBLE, round(0.8::DOUBLE * max(score) OVER (PARTITION BY qid), 9)) AS floor FROM sentence_scores),
  once AS (SELECT *, row_number() OVER (PARTITION BY qid, title, source, date ORDER BY score DESC, context_rank, sentence_no) AS copy FROM floors WHERE score >= floor),
  places AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, context_rank, sentence_no)::INT AS place FROM once WHERE copy = 1),
  tops AS (SELECT * FROM places WHERE place <= 2)"""


def answers(dim: int = 256, questions: str = "SELECT item_id AS qid, text AS question FROM benchmark") -> str:
    return f"""{top_sentences(dim, questions)},
  given AS (SELECT qid, list(sentence ORDER BY place) AS evidence, list(title || ' (' || source || ', ' || date || ')' ORDER BY place) AS labels FROM tops GROUP BY 1),
  answers AS (SELECT qid, CASE WHEN evidence IS NULL THEN 'insufficient information' ELSE array_to_string(evidence, ' ') END AS answer,
    CASE WHEN labels IS NULL THEN []::VARCHAR[] WHEN len(labels) = 2 AND labels[1] = labels[2] THEN labels[1:1] ELSE labels END AS sources, coalesce(evidence, []::VARCHAR[]) AS evidence FROM questions LEFT JOIN given USING (qid))"""


def formatted() -> str:
    bullets = "CASE WHEN len(sources) = 0 THEN '- None' ELSE array_to_string(list_transform(sources, lambda s: '- ' || s), chr(10)) END"
    items = "CASE WHEN len(evidence) = 0 THEN '1. insufficient information' ELSE array_to_string(list_transform(evidence, lambda s, i: i || '. ' || s), chr(10)) END"
    return f"'Answer:' || chr(10) || answer || chr(10) || chr(10) || 'Sources:' || chr(10) || {bullets} || chr(10) || chr(10) || 'Evidence:' || chr(10) || {items}"


def oracle(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes}\n{select}"


oracle("rerank_topk", reranked(), "SELECT qid, rank, chunk_id, round(embedding_score, 6) AS embedding_score, round(score, 6) AS score FROM retrieved")
oracle("hash_topk", topk(4), "SELECT qid, rank, position, round(embedding_score, 6) AS embedding_score FROM found")
ORACLES["hash_topk_postings"] = ORACLES["hash_topk"]
oracle(
    "vec_topk",
    "e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS qid, b.vec_id AS position, round(list_dot_product(a.v, b.v), 9) AS s FROM e a, e b WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, position)::INT AS rank FROM s)",
    "SELECT qid, rank, position, round(s, 6) AS score FROM r WHERE rank <= 10",
)
_joined = lambda table: "CASE " + " ".join(f"WHEN k = {q(n)} THEN {q('|'.join(v))}" for n, v in table.items()) + " END"
oracle("query_classify", f"t AS (SELECT conv_id, turn, {kind('text')} AS k FROM conversations)", f"SELECT conv_id, turn, k AS query_type, {_joined(rules.QUERY_SECTIONS)} AS sections, {_joined(rules.QUERY_TOPICS)} AS topics FROM t")
oracle(
    "rerank_scores", CHUNKS + ", kinds AS (SELECT unnest(['risk', 'business', 'performance', 'general']) AS query_type)",
    f"SELECT chunk_id, query_type, {section_bonus('section', 'query_type')} AS section_bonus, {topic_bonus('query_type')} AS topic_bonus, {QUALITY} AS quality_bonus FROM chunks, kinds",
)
oracle("doc_validate", DOCS, f"SELECT doc_id::VARCHAR AS doc_id, title, {strip('source')} AS source, {strip('category')} AS category, length({strip('content')})::INT AS n FROM docs WHERE title <> '' AND {strip('source')} <> '' AND {strip('category')} <> '' AND {strip('content')} <> ''")
oracle("doc_reject_reasons", DOCS, f"SELECT CASE WHEN doc_id % 7 = 0 OR title = '' THEN 'empty title' WHEN doc_id % 11 = 0 THEN 'missing source' WHEN {strip('content')} = '' THEN 'empty content' ELSE 'ok' END AS reason, count(*) AS n FROM docs GROUP BY 1")
oracle("chunk_fixed", pieces(), "SELECT doc_id || '_chunk_' || chunk_index AS chunk_id, doc_id, chunk_index::INT AS chunk_index, length(text)::INT AS n, md5(text) AS hash FROM pieces")
oracle("chunk_counts", pieces(), "SELECT category, sum(n)::BIGINT AS chunks, max(n)::INT AS most FROM (SELECT d.doc_id, d.category, count(p.doc_id) AS n FROM docs d LEFT JOIN pieces p USING (doc_id) GROUP BY 1, 2) GROUP BY 1")
oracle("chunk_custom_size", pieces(200, 50), "SELECT doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM pieces GROUP BY 1")
oracle("embedding_text", CHUNKS, "SELECT chunk_id, md5(t) AS hash FROM embedded JOIN chunks USING (position)")
oracle("tok_embed", "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)", "SELECT doc_id, len(t)::INT AS tokens, md5(array_to_string(t, ' ')) AS hash FROM t")
oracle("tok_lexical", f"t AS (SELECT doc_id, {lexical('text')} AS t FROM documents)", "SELECT doc_id, len(t)::INT AS tokens, md5(array_to_string(t, ' ')) AS hash FROM t")
oracle("hash_buckets", buckets("documents", "doc_id", "text", 256, "b"), "SELECT doc_id, bucket, value FROM b WHERE value <> 0")
oracle("hash_norm", buckets("documents", "doc_id", "text", 64, "b"), "SELECT doc_id, round(sqrt(sum(value * value)), 6) AS norm FROM b GROUP BY 1")
oracle("select_context", context(), "SELECT qid, context_rank, chunk_id FROM context")
oracle("sentence_split", f"s AS (SELECT doc_id, unnest({sentences('text')}) AS s FROM documents)", "SELECT doc_id, count(*) AS sentences, max(length(s))::INT AS longest FROM s GROUP BY 1")
oracle("sentence_scores", scored_sentences(), "SELECT qid, context_rank, sentence_no::INT AS sentence_no, md5(sentence) AS hash, round(score, 6) AS score FROM sentence_scores")
oracle("sentence_top2", top_sentences(), "SELECT qid, place, context_rank, sentence_no::INT AS sentence_no, round(score, 6) AS score FROM tops")
_block = "string_agg('[Chunk ' || context_rank || ']' || chr(10) || 'Chunk ID: ' || chunk_id || chr(10) || 'Title: ' || title || chr(10) || 'Source: ' || source || chr(10) || 'Date: ' || date || chr(10) || text, chr(10) || chr(10) ORDER BY context_rank)"
oracle("context_block", context() + f", blocks AS (SELECT qid, {_block} AS b FROM context GROUP BY 1)", "SELECT qid, length(b)::INT AS n, md5(b) AS hash FROM blocks")
oracle("prompt_text", context() + f", blocks AS (SELECT qid, {_block} AS b FROM context GROUP BY 1)", f"SELECT qid, ({len(SYSTEM) + len(OUTPUT_FORMAT) + 4 + len('[Question]') + 1} + length(question) + 2 + length('[Context]') + 1 + coalesce(length(b), 0))::INT AS n FROM questions LEFT JOIN blocks USING (qid)")
oracle("answer_format", answers(), f"SELECT qid, md5({formatted()}) AS hash, len(sources)::INT AS sources, len(evidence)::INT AS evidence FROM answers")
oracle("parse_answer", answers(), "SELECT qid, length(answer)::INT AS n_answer, CASE WHEN len(sources) = 0 THEN 1 ELSE len(sources) END::INT AS sources, len(evidence)::INT AS evidence FROM answers")
oracle("grounded_answers", answers(), "SELECT qid, length(answer)::INT AS n_answer, len(sources)::INT AS sources, len(evidence)::INT AS evidence FROM answers")
_checks = f"""{DOCS}, checks AS (SELECT *, {sentences("content")} AS ss, {lexical("content")} AS tt FROM docs), made AS (SELECT *, coalesce(ss[1], '') AS first, coalesce(tt[1], '') || ' qqqq' AS guess FROM checks)"""
oracle("source_filter", DOCS, "SELECT doc_id, (2 + CASE WHEN contains('elsewhere', title) THEN 1 ELSE 0 END)::INT AS kept FROM docs")
_match = lambda e: f"(len({lexical(e)}) > 0 AND (contains(content, {e}) OR len(list_filter(ss, lambda s: len(list_intersect(list_distinct({lexical('s')}), list_distinct({lexical(e)}))) >= 2)) > 0))"
_count = " + ".join("CASE WHEN " + _match(e) + " THEN 1 ELSE 0 END" for e in ("'zzzz qqqq'", "first", "guess"))
oracle("evidence_filter", _checks, f"SELECT doc_id, least(2, {_count})::INT AS kept FROM made")
oracle("evidence_build", _checks + f", out AS (SELECT doc_id, list_filter(ss, lambda s: list_has_any({lexical('s')}, {lexical('guess')}))[1:2] AS o FROM made)", "SELECT doc_id, len(o)::INT AS n, md5(array_to_string(o, chr(10))) AS hash FROM out")

PAIRS = f"""turns AS (SELECT conv_id, turn, role, {strip("text")} AS t FROM conversations),
  first_turns AS (SELECT conv_id, arg_min(t, turn) FILTER (WHERE role = 'user' AND t <> '') AS question, arg_min(t, turn) FILTER (WHERE role = 'assistant' AND t <> '') AS answer FROM turns GROUP BY 1),
  pairs AS (SELECT * FROM first_turns WHERE length(question) >= 20 AND length(answer) >= 40)"""
oracle("qa_cases", PAIRS, "SELECT conv_id, question, answer FROM pairs")
oracle(
    "qa_sample",
    PAIRS + """, numbered AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS i, count(*) OVER () AS n FROM pairs), stepped AS (SELECT * FROM numbered WHERE i % greatest(n // 30, 1) = 0),
  once AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY i) AS copy FROM stepped), kept AS (SELECT *, row_number() OVER (ORDER BY i) AS place FROM once WHERE copy = 1)""",
    "SELECT 'q' || place AS qid, conv_id, question, answer AS reference_answer FROM kept WHERE place <= 30",
)
_overlap = lambda a, r: f"CASE WHEN len({lexical(a)}) = 0 OR len({lexical(r)}) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({lexical(a)}), list_distinct({lexical(r)}))) / len(list_distinct({lexical(r)})) END"
oracle("lexical_overlap", PAIRS, f"SELECT conv_id, round({_overlap('answer', 'question')}, 6) AS overlap FROM first_turns WHERE question IS NOT NULL AND answer IS NOT NULL")


def evaluated(dim: int) -> str:
    asked = f"WITH {PAIRS} SELECT conv_id AS qid, question, answer AS reference FROM pairs"
    return answers(dim, asked) + f", results AS (SELECT qid, answer, sources, evidence, {_overlap('answer', 'reference')} AS overlap FROM answers JOIN questions USING (qid))"


oracle(
    "eval_summary", evaluated(256),
    """SELECT count(*) AS case_count, count(*) FILTER (WHERE answer <> 'insufficient information') AS answered_count, count(*) FILTER (WHERE answer = 'insufficient information') AS insufficient_information_count,
  round(coalesce(avg(overlap), 0), 6) AS avg_lexical_overlap, round(coalesce(avg(len(sources)), 0), 6) AS avg_sources_per_answer, round(coalesce(avg(len(evidence)), 0), 6) AS avg_evidence_items_per_answer FROM results""",
)
ORACLES["backend_compare"] = f"SELECT qid, a.o AS hashing_256, b.o AS hashing_64 FROM (WITH {evaluated(256)} SELECT qid, round(overlap, 6) AS o FROM results) a JOIN (WITH {evaluated(64)} SELECT qid, round(overlap, 6) AS o FROM results) b USING (qid)"
oracle(
    "retrieval_debug", reranked(),
    """SELECT qid, rank, '- ' || rank || '. score=' || printf('%.4f', score) || ', embedding=' || printf('%.4f', embedding_score) || ', section=' || section || ', primary_topic=' || primary_topic || ', secondary_topic=n/a, quality=' || quality || ', title=' || title AS line FROM retrieved""",
)

_categories = "CASE " + " ".join(f"WHEN {any_of('title || chr(10) || content', n)} THEN {q(c)}" for c, n in rules.ARTICLE_CATEGORIES) + " ELSE 'general' END"
ARTICLES = f"""{DOCS}, named AS (SELECT doc_id + 1 AS line, {listed(("gdp", "LNG", "贷款", "A50", "ipo", "订单", "none"))}[(doc_id % 7 + 1)::INT] || ' ' || (doc_id % 50) AS title, {strip("content")} AS content,
    CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE source END AS source, CASE WHEN doc_id % 2 = 0 THEN '2024-05-06' ELSE '6 May 2024' END AS date FROM docs),
  articles AS (SELECT line, 'demo_' || CASE WHEN line < 10000 THEN lpad(line::VARCHAR, 4, '0') ELSE line::VARCHAR END AS doc_id, title, source, date, content, {_categories} AS category FROM named WHERE length(content) >= 180)"""
oracle("article_normalize", ARTICLES, "SELECT line, doc_id, title, source, date, length(content)::INT AS n FROM articles")
oracle("article_categories", ARTICLES, "SELECT category, count(*) AS n FROM articles GROUP BY 1")
oracle(  # a title has one category here, so the greedy choice is a window
    "demo_sample",
    ARTICLES + """, once AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY line) AS copy FROM articles WHERE category <> 'general'), five AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY line) AS n FROM once WHERE copy = 1),
  twenty AS (SELECT *, row_number() OVER (ORDER BY line) AS place FROM five WHERE n <= 5)""",
    "SELECT line, doc_id, title, category FROM twenty WHERE place <= 20",
)

BLOCKS = f"""raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), lines AS (SELECT doc_id AS doc, unnest(ls) AS line, unnest(range(0, len(ls))) AS ordinal FROM raw),
  spaced AS (SELECT doc, ordinal, {spaces("CASE WHEN ordinal % 9 = 3 THEN 'Item ' || ordinal || '. Part.' ELSE line END")} AS text, {listed(rules.SECTIONS)}[(doc % 3 + 1)::INT] AS section FROM lines),
  blocks AS (SELECT * FROM spaced WHERE text <> '')"""
oracle("section_bounds", BLOCKS + ", starts AS (SELECT doc, min(ordinal) AS s FROM blocks WHERE regexp_full_match(text, 'Item \\d+\\. Part\\.') GROUP BY 1)", "SELECT doc, s::INT AS start_ordinal, (SELECT min(ordinal) FROM blocks b WHERE b.doc = starts.doc AND b.ordinal > s AND regexp_full_match(text, 'Item \\d+\\. Part\\.'))::INT AS end_ordinal FROM starts")
oracle("discussion_bounds", BLOCKS + ", next AS (SELECT *, lead(text) OVER (PARTITION BY doc ORDER BY ordinal) AS following FROM blocks), starts AS (SELECT doc, min(ordinal) AS s FROM next WHERE text = 'Item 3. Part.' AND following IS NOT NULL GROUP BY 1)", "SELECT doc, s::INT AS start_ordinal, (SELECT min(ordinal) FROM blocks b WHERE b.doc = starts.doc AND b.ordinal > s AND text = 'Item 12. Part.')::INT AS end_ordinal FROM starts")
_metric = lambda x: f"((regexp_matches({x}, '\\d') AND {words(x)} <= 5) OR list_contains({listed(rules.METRIC_LABELS)}, {x}))"
_starts = lambda x, items: "(" + " OR ".join(f"starts_with({x}, {q(s)})" for s in items) + ")"
_skip = f"""(list_contains({listed(rules.SKIP_EXACT)}, text) OR regexp_full_match(text, '\\d{{1,3}}') OR regexp_full_match(text, '[$%()\\-.,\\d]+') OR {any_of("text", rules.SKIP_CONTAINS)} OR {any_of("lower(text)", rules.SKIP_CONTAINS_LOWER)}
  OR (starts_with(lower(text), 'refer to ') AND regexp_matches(text, '(?i)\\bpages?\\b|\\bnote\\b')) OR {_starts("lower(text)", rules.SKIP_STARTS_LOWER)}
  OR ({_starts("lower(text)", rules.SKIP_STARTS_IF_REFERS)} AND contains(lower(text), 'refer to')) OR regexp_matches(text, '^\\([a-z]\\)\\s'))"""
oracle("skip_flags", BLOCKS, f"SELECT doc, ordinal::INT AS ordinal, {_skip} AS skip, {_metric('text')} AS metric FROM blocks")
oracle("normalize_spaces", DOCS, f"SELECT doc_id, length(x)::INT AS n, md5(x) AS hash FROM (SELECT doc_id, {spaces(chr(39) + '( “a” ,b ' + chr(39) + ' || content || ' + chr(39) + ' – c’s )' + chr(39))} AS x FROM docs)")
oracle("count_words", DOCS, f"SELECT doc_id, {words('content')}::INT AS words FROM docs")
oracle("section_counts", CHUNKS, "SELECT section, count(*) AS chunks FROM chunks GROUP BY 1")
oracle("quality_label", DOCS + ", t AS (SELECT doc_id, content AS x FROM docs)", f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN length(x) BETWEEN 300 AND 1200 THEN 'high' ELSE 'medium' END WHEN length(x) BETWEEN 300 AND 1200 AND {words('x')} >= 35 THEN 'high' WHEN length(x) BETWEEN 150 AND 1500 THEN 'medium' ELSE 'low' END AS quality FROM t")

_REFERENCES = (  # the cross references of a paragraph, as RE2
    r"\s*(?:For (?:more|further|additional) information[^.]*,\s*)?refer to [^.]+(?:\.|$)",
    r"\s*For additional discussion[^.]*refer to [^.]+(?:\.|$)",
    r"\s*The following tables? (?:summarizes?|provides?|presents?|sets forth)[^.]+(?:\.|$)",
    r"\s*The table below [^.]+(?:\.|$)",
    r"\s*The following graph [^.]+(?:\.|$)",
    r"\s+provided in the following table",
    r"\s*[^.]*\b(?:provided|reported|captured|presented)\s+in\s+(?:the\s+)?(?:table below|following table)[^.]*[.:]?",
)


def cleaned(source: str, key: str, x: str, name: str) -> str:
    """CTEs that clean a column step by step."""
    ctes = [f"{name}0 AS (SELECT {key}, {spaces(x)} AS x FROM {source})"]
    for i, pattern in enumerate(_REFERENCES):
        ctes.append(f"{name}{i + 1} AS (SELECT {key}, regexp_replace(x, {q('(?i)' + pattern)}, '', 'g') AS x FROM {name}{i})")
    ctes.append(f"{name} AS (SELECT {key}, {spaces('x')} AS x FROM {name}{len(_REFERENCES)})")
    return ", ".join(ctes)


_SURROUNDED = "'Kept. For more information on this, refer to page 5. ' || content || ' The following table presents it. As reported in the table below: x'"
oracle("clean_paragraph", DOCS + ", " + cleaned("docs", "doc_id", _SURROUNDED, "c"), "SELECT doc_id, length(x)::INT AS n, md5(x) AS hash FROM c")
_heading = f"""CASE WHEN x = '' OR starts_with(x, '• ') THEN false WHEN regexp_full_match(x, 'Item\\s+\\d+[A-Z]?\\..*') THEN true WHEN ends_with(x, ':') AND length(x) <= 140 THEN true
  WHEN length(x) <= 95 AND NOT ends_with(x, '.') AND {words("x")} <= 12 THEN NOT {_metric("x")} WHEN regexp_matches(x, '\\p{{L}}') AND upper(x) = x AND length(x) <= 120 THEN true
  WHEN section = {q(rules.RISK)} THEN length(x) <= 220 AND ends_with(x, '.') AND {words("x")} <= 28 AND {_starts("x", rules.RISK_STARTERS)} ELSE false END"""
oracle("heading_flags", BLOCKS + ", " + cleaned("blocks", "doc, ordinal, section", "text", "c"), f"SELECT doc, ordinal::INT AS ordinal, {_heading} AS heading FROM c")
_breaks = "regexp_replace(" + spaces("content") + ", '([.!?]) ([A-Z0-9\"''])', '\\1' || chr(10) || '\\2', 'g')"
oracle("prose_sentences", DOCS, f"SELECT doc_id, len(list_filter(string_split({_breaks}, chr(10)), lambda s: s <> ''))::INT AS sentences FROM docs")

_TITLES = [n for n, _ in (*rules.TOPIC_RULES, *rules.RISK_TOPICS)] + ["business", "Risk factors", "net income was up", "plain, cut here", "var moved"]
_case = lambda x, table: " ".join(f"WHEN contains({x}, {q(n)}) THEN {q(t)}" for n, t in table)
_raw = "regexp_replace(title, '[.:]+$', '')"
_generic = "CASE lower(" + _raw + ") " + " ".join(f"WHEN {q(n)} THEN {q(t)}" for n, t in rules.GENERIC_TITLES.items()) + " END"
_short = f"regexp_replace(string_split_regex({_raw}, {q(rules.TITLE_CUT)})[1], '^[ .:\\-]+|[ .:\\-]+$', '', 'g')"
_seven = f"array_to_string(string_split({_short}, ' ')[1:7], ' ')"


def _secondary(table: str, hay: str) -> str:
    if table not in rules._SECONDARY:
        return q(table)
    groups, last = rules._SECONDARY[table]
    return "CASE " + " ".join(f"WHEN {any_of(hay, n)} THEN {q(g)}" for g, n in groups) + f" ELSE {q(last)} END"


def _taxonomy(secondary: bool) -> str:
    out = "CASE "
    for section, table in rules.TAXONOMY.items():
        arms = " ".join(f"WHEN {any_of('low' if where == 'topic' else 'hay', needles)} THEN {_secondary(second, 'hay') if secondary else q(first)}" for where, needles, first, second in table)
        out += f"WHEN section = {q(section)} THEN CASE {arms} END "
    return out + "END"


# Topics and taxonomy over whole texts: title and text are searched, the topic first in the taxonomy.
_ALL = f"{DOCS}, titled AS (SELECT doc_id, {listed(_TITLES)}[(doc_id % {len(_TITLES)} + 1)::INT] AS title, {listed(rules.SECTIONS)}[((doc_id // {len(_TITLES)}) % 3 + 1)::INT] AS section, content FROM docs)"
_found = f"""CASE {_case("both_low", rules.PRIORITY_TOPICS)} WHEN section = {q(rules.MDA)} AND regexp_matches(both_low, '\\bvar\\b') THEN 'Value-at-risk' {_case("both_low", rules.TOPIC_RULES)}
  WHEN section = {q(rules.RISK)} THEN CASE {_case("both_low", rules.RISK_TOPICS)} ELSE 'Risk factor' END ELSE coalesce({_generic}, nullif({_seven}, ''), section) END"""
_LABELLED = f"{_ALL}, searched AS (SELECT *, lower({_raw} || ' ' || content) AS both_low FROM titled), labelled AS (SELECT doc_id, section, title, content, {_found} AS topic FROM searched)"
_low = f"(lower(topic) IN ({', '.join(q(t) for t in rules.LOW_VALUE_TOPICS)}) OR {_starts('lower(content)', rules.LOW_VALUE_STARTS)} OR {any_of('lower(content)', rules.LOW_VALUE_CONTAINS)})"
_cut = f"regexp_replace(regexp_replace(CASE WHEN {strip('topic')} <> '' THEN {strip('topic')} ELSE {strip('title')} END, '{B}+', ' ', 'g'), '^[ .:\\-]+|[ .:\\-]+$', '', 'g')"
oracle("semantic_topic", _LABELLED + f", cut AS (SELECT *, {_cut} AS c FROM labelled)", f"SELECT doc_id, topic, {_low} AS low_value, CASE WHEN length(c) <= 80 THEN c ELSE regexp_replace(substr(c, 1, 77), '{B}+$', '') || '...' END AS title FROM cut")
oracle("taxonomy", _ALL + ", hays AS (SELECT doc_id, section, lower(title) AS low, lower(title || '  ' || content) AS hay FROM titled)", f"SELECT doc_id, {_taxonomy(False)} AS primary_topic, {_taxonomy(True)} AS secondary_topic FROM hays")
oracle("topic_of_text", _LABELLED, f"SELECT doc_id, topic, {_low} AS low_value FROM labelled")
oracle(
    "taxonomy_of_text", _LABELLED + ", hays AS (SELECT doc_id, section, topic, lower(topic) AS low, lower(topic || ' ' || title || ' ' || content) AS hay FROM labelled)",
    f"SELECT doc_id, topic, {_taxonomy(False)} AS primary_topic, {_taxonomy(True)} AS secondary_topic FROM hays",
)

# Texts under a topic of 12 characters, and one more line whose own prefix, the topic in capitals, goes. Capitals of ß are SS (DuckDB's upper() gives one letter).
def _unprefixed(x: str) -> str:
    tail = f"substr({x}, length(topic) + 1)"
    return f"CASE WHEN lower(substr({x}, 1, length(topic))) = lower(topic) AND regexp_matches({tail}, '^\\s*:') THEN regexp_extract({tail}, '(?s)^\\s*:\\s*(.*)$', 1) ELSE {x} END"


_lines = f"array_to_string(list_transform(string_split(x, chr(10)), lambda l: {spaces('l')}), chr(10))"
_under = "CASE WHEN starts_with(lower(y), lower(topic)) THEN y ELSE topic || ': ' || y END"
oracle(
    "topic_prefix",
    f"""{DOCS}, topics AS (SELECT doc_id, substr(title, 1, 12) AS topic, {strip("substr(title, 1, 12) || ':  ' || title")} AS given, {strip("upper(replace(substr(title, 1, 12), 'ß', 'ss')) || ' : x'")} AS line, content AS x FROM docs),
  first_lines AS (SELECT *, {_lines} AS y FROM topics),
  joined AS (SELECT doc_id, topic, given, {_under} || chr(10) || {_unprefixed("line")} AS x FROM first_lines),
  all_lines AS (SELECT *, {_lines} AS y FROM joined)""",
    f"SELECT doc_id, length({_under})::INT AS n, length({_unprefixed('given')})::INT AS rest FROM all_lines",
)
