"""Registered queries of the engine; each takes (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import rules
from skein.functions import text as T
from skein.operators import answering, chunking, embedding, evaluation, filing, retrieval, sampling
from skein.plans import tables
from skein.storage import Scratch

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- Retrieval ---


@query
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: chunks, hashing vectors, batched top-k and reranking for every benchmark question."""
    return _retrieved(spark, sf_dir).select("qid", "rank", "chunk_id", F.round("embedding_score", 6).alias("embedding_score"), F.round("score", 6).alias("score"))


@query
def hash_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.search(tables.questions(spark, sf_dir), tables.indexed(spark, sf_dir), 4)
    return out.select("qid", "rank", "position", F.round("embedding_score", 6).alias("embedding_score"))


@query
def hash_topk_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the grid of blocks, as for any number of questions."""
    out = retrieval.search_grid(tables.questions(spark, sf_dir), tables.indexed(spark, sf_dir), 4)
    return out.select("qid", "rank", "position", F.round("embedding_score", 6).alias("embedding_score"))


@query
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products for every hundredth of the stored vectors."""
    e = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("position"), F.col("embedding").cast("array<double>").alias("vector"))
    out = retrieval.search_vectors(e.where("position % 100 = 0").withColumnRenamed("position", "qid"), e, 10)
    return out.select("qid", "rank", "position", F.round("embedding_score", 6).alias("score"))


@query
def query_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", rules.query_type(F.col("text")).alias("query_type"))
    return said.select("conv_id", "turn", "query_type", F.array_join(rules.query_sections(F.col("query_type")), "|").alias("sections"), F.array_join(rules.query_topics(F.col("query_type")), "|").alias("topics"))


@query
def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonuses of every chunk for each kind of question."""
    kinds = spark.createDataFrame([(k,) for k in rules.QUERY_SECTIONS], "query_type string")
    c, k = tables.chunks(spark, sf_dir).join(F.broadcast(kinds)), F.col("query_type")
    return c.select(
        "chunk_id", "query_type", rules.section_bonus(F.col("section"), k).alias("section_bonus"),
        rules.topic_bonus(F.col("primary_topic"), F.col("secondary_topic"), k).alias("topic_bonus"), rules.quality_bonus(F.col("quality")).alias("quality_bonus"),
    )


# --- Documents, chunks, tokens, vectors ---


@query
def doc_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))
    return chunking.validated(d).select("doc_id", "title", "source", "category", F.length("content").alias("n"))


@query
def doc_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))
    d = d.withColumn("title", F.when(F.col("doc_id").cast("long") % 7 == 0, " \t").otherwise(F.col("title"))).withColumn("source", F.when(F.col("doc_id").cast("long") % 11 == 0, None).otherwise(F.col("source")))
    return d.select(F.coalesce(chunking.reject_reason(), F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(tables.documents(spark, sf_dir)).select("chunk_id", "doc_id", "chunk_index", F.length("text").alias("n"), F.md5("text").alias("hash"))


@query
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(chunking.windows(F.col("content")))
    return tables.documents(spark, sf_dir).groupBy("category").agg(F.sum(n).alias("chunks"), F.max(n).alias("most"))


@query
def chunk_custom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunk_documents(tables.documents(spark, sf_dir), chunking.ChunkingConfig(200, 50))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


@query
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunks(spark, sf_dir).select("chunk_id", F.md5(chunking.embedding_text()).alias("hash"))


@query
def tok_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.word_tokens(F.col("content"))
    return tables.documents(spark, sf_dir).select("doc_id", F.size(t).alias("tokens"), F.md5(F.array_join(t, " ")).alias("hash"))


@query
def tok_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.lexical_tokens(F.col("content"))
    return tables.documents(spark, sf_dir).select("doc_id", F.size(t).alias("tokens"), F.md5(F.array_join(t, " ")).alias("hash"))


@query
def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.bucket_sums(tables.documents(spark, sf_dir), "doc_id", "content").where("value <> 0").select("doc_id", "bucket", "value")


@query
def hash_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding.bucket_sums(tables.documents(spark, sf_dir), "doc_id", "content", 64)
    return rows.groupBy("doc_id").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 6).alias("norm"))


# --- Answers ---


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve(tables.questions(spark, sf_dir), tables.indexed(spark, sf_dir), texts=lambda found: tables.chunks(spark, sf_dir, found))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.select_context(_retrieved(spark, sf_dir))


@query
def select_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).select("qid", "context_rank", "chunk_id")


@query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("content"))).alias("n", "s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).alias("longest"))


@query
def sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answering.sentence_scores(_context(spark, sf_dir), tables.questions(spark, sf_dir))
    return out.select("qid", "context_rank", "sentence_no", F.md5("sentence").alias("hash"), F.round("score", 6).alias("score"))


@query
def sentence_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answering.top_sentences(answering.sentence_scores(_context(spark, sf_dir), tables.questions(spark, sf_dir)))
    return out.select("qid", "place", "context_rank", "sentence_no", F.round("score", 6).alias("score"))


@query
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.context_block(_context(spark, sf_dir)).select("qid", F.length("context").alias("n"), F.md5("context").alias("hash"))


@query
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.prompts(_context(spark, sf_dir), tables.questions(spark, sf_dir)).select("qid", F.length("prompt").alias("n"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.answer(tables.questions(spark, sf_dir), _retrieved(spark, sf_dir))


@query
def answer_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answering.formatted(F.col("answer"), F.col("sources"), F.col("evidence"), display=True)
    return _answers(spark, sf_dir).select("qid", F.md5(out).alias("hash"), F.size("sources").alias("sources"), F.size("evidence").alias("evidence"))


@query
def parse_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _answers(spark, sf_dir).select("qid", answering.formatted(F.col("answer"), F.col("sources"), F.col("evidence")).alias("raw"))
    p = answering.parsed(F.col("raw"))
    return raw.select("qid", F.length(p["answer"]).alias("n_answer"), F.size(p["sources"]).alias("sources"), F.size(p["evidence"]).alias("evidence"))


@query
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted answers parsed again and checked against their context."""
    found = Scratch(spark).save(_retrieved(spark, sf_dir), "retrieved")  # a few chunks of each question, for the answers and for their check
    a, context = answering.answer(tables.questions(spark, sf_dir), found), answering.select_context(found)
    raw = a.select("qid", answering.formatted(F.col("answer"), F.col("sources"), F.col("evidence")).alias("raw"))
    return answering.grounded(raw, context).select("qid", F.length("answer").alias("n_answer"), F.size("sources").alias("sources"), F.size("evidence").alias("evidence"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contexts of their own, with made-up sources and evidence."""
    d = tables.documents(spark, sf_dir)
    label = answering.source_label(F.col("title"), F.col("source"), F.col("date"))
    first = F.coalesce(F.get(T.sentences(F.col("content")), F.lit(0)), F.lit(""))
    words = F.coalesce(F.get(T.lexical_tokens(F.col("content")), F.lit(0)), F.lit(""))
    return d.select(
        "doc_id", F.array("content").alias("texts"), F.array(label).alias("valid"), F.array("title").alias("titles"),
        F.array(label, F.concat(F.lit("see "), F.col("title")), F.lit("elsewhere")).alias("sources"), F.array(F.lit("zzzz qqqq"), first, F.concat(words, F.lit(" qqqq"))).alias("evidence"),
    )


@query
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("doc_id", F.size(answering.kept_sources(F.col("sources"), F.col("valid"), F.col("titles"))).alias("kept"))


@query
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("doc_id", F.size(answering.kept_evidence(F.col("evidence"), F.col("texts"))).alias("kept"))


@query
def evidence_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answering.built_evidence(F.col("texts"), F.get("evidence", F.lit(2)))
    return _checked(spark, sf_dir).select("doc_id", F.size(out).alias("n"), F.md5(F.array_join(out, "\n")).alias("hash"))


@query
def retrieval_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir).select("qid", "rank", answering.debug_line().alias("line"))


# --- Evaluation ---


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluation.usable_pairs(tables.read(spark, sf_dir, "conversations"))
    return pairs.select(F.col("conv_id").alias("qid"), "question", F.col("answer").alias("reference_answer"))


def _results(spark: SparkSession, sf_dir: str, dimension: int = 256) -> DataFrame:
    cases = _cases(spark, sf_dir)
    q = cases.withColumn("codes", T.word_tokens(F.col("question")))
    found = retrieval.retrieve(q, tables.indexed(spark, sf_dir), dimension=dimension, texts=lambda found: tables.chunks(spark, sf_dir, found))
    found = Scratch(spark).save(found, "retrieved")
    return evaluation.results(cases, answering.answer(q, found))


@query
def qa_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.usable_pairs(tables.read(spark, sf_dir, "conversations"))


@query
def qa_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluation.usable_pairs(tables.read(spark, sf_dir, "conversations"))
    return sampling.sample_cases(pairs, "conv_id").select("qid", "conv_id", "question", "reference_answer")


@query
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluation.first_turns(tables.read(spark, sf_dir, "conversations")).where("question is not null and answer is not null")
    return pairs.select("conv_id", F.round(evaluation.lexical_overlap(F.col("answer"), F.col("question")), 6).alias("overlap"))


@query
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_results(spark, sf_dir))


@query
def backend_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashing vectors of two dimensions, side by side."""
    rows, _ = evaluation.compare({f"hashing_{n}": lambda n=n: _results(spark, sf_dir, n) for n in (256, 64)})
    return evaluation.side_by_side(rows, ["hashing_256", "hashing_64"])


# --- Samples of articles ---


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw articles, with a needle of some category in every title."""
    d = tables.documents(spark, sf_dir)
    needles = F.array(*[F.lit(x) for x in ("gdp", "LNG", "贷款", "A50", "ipo", "订单", "none")])
    return sampling.articles(d.select(
        (F.col("doc_id") + 1).alias("line"), F.col("doc_id").alias("id"), F.concat(F.get(needles, (F.col("doc_id") % 7).cast("int")), F.lit(" "), (F.col("doc_id") % 50).cast("string")).alias("title"),
        F.col("content").alias("text"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 2 == 0, "2024-05-06T07:08:09").otherwise("6 May 2024, noon").alias("time"),
    ))


@query
def article_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("line", "doc_id", "title", "source", "date", F.length("content").alias("n"))


@query
def article_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query
def demo_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_articles(_articles(spark, sf_dir)).select("line", "doc_id", "title", "category")


# --- Filings ---


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as blocks; every third document is a section of each kind, some lines are headings and table cells."""
    d = tables.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    sections = F.array(*[F.lit(s) for s in rules.SECTIONS])
    return d.select(
        F.col("doc_id").alias("doc"), F.get(sections, (F.col("doc_id") % 3).cast("int")).alias("section"), "ordinal",
        T.kept(lambda c: c["text"] != "", T.normalize_spaces(F.when(F.col("ordinal") % 9 == 3, F.concat(F.lit("Item "), F.col("ordinal").cast("string"), F.lit(". Part."))).otherwise(F.col("text"))).alias("text")),
        (F.floor(F.col("ordinal") / 10) % 3 == 1).alias("in_table"),
    )


@query
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing.html_blocks(tables.read(spark, sf_dir, "pages"))


@query
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages, in one pass over their blocks: from the first block that ends a sentence to the first without a full stop, and on from there to the notice of rights."""
    specs = (filing.SectionSpec("text", r".*\.", r"[^.]*"), filing.SectionSpec("rest", r"[^.]*", ".*©.*", after="text"), filing.SectionSpec("titled", r"[^.©]*", ".*©.*", opening="A"))
    rows = filing.sectioned(filing.html_blocks(tables.read(spark, sf_dir, "pages")), "page_id", specs=specs)
    return rows.groupBy("page_id", "section").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("blocks"))


@query
def section_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing.section_bounds(_blocks(spark, sf_dir), r"Item \d+\. Part\.", r"Item \d+\. Part\.")


@query
def discussion_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing.discussion_bounds(_blocks(spark, sf_dir), "Item 3. Part.", "", "Item 12. Part.")


@query
def heading_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = filing.flagged(_blocks(spark, sf_dir))
    return x.select("doc", "ordinal", "heading")


@query
def skip_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("doc", "ordinal", rules.skip_block(F.col("text")).alias("skip"), rules.metric_row(F.col("text")).alias("metric"))


@query
def normalize_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = T.normalize_spaces(F.concat(F.lit("( “a” ,b "), F.col("content"), F.lit(" – c’s )")))
    return tables.documents(spark, sf_dir).select("doc_id", F.length(x).alias("n"), F.md5(x).alias("hash"))


@query
def clean_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document between sentences that are cross references."""
    x = F.concat(F.lit("Kept. For more information on this, refer to page 5. "), F.col("content"), F.lit(" The following table presents it. As reported in the table below: x"))
    return tables.documents(spark, sf_dir).select("doc_id", F.length(T.clean_paragraph(x)).alias("n"), F.md5(T.clean_paragraph(x)).alias("hash"))


@query
def count_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).select("doc_id", T.count_words(F.col("content")).alias("words"))


@query
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing.section_chunks(filing.flagged(_blocks(spark, sf_dir)))


@query
def filing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing.postprocess(filing.section_chunks(filing.flagged(_blocks(spark, sf_dir))))


@query
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filing.section_counts(tables.chunks(spark, sf_dir))


def _topical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with needles of the rules in their titles."""
    d = tables.documents(spark, sf_dir)
    needles = F.array(*[F.lit(n) for n, _ in (*rules.TOPIC_RULES, *rules.RISK_TOPICS)], *[F.lit(x) for x in ("business", "Risk factors", "net income was up", "plain, cut here", "var moved")])
    sections = F.array(*[F.lit(s) for s in rules.SECTIONS])
    n = len(rules.TOPIC_RULES) + len(rules.RISK_TOPICS) + 5
    return d.select(
        "doc_id", F.get(needles, (F.col("doc_id") % n).cast("int")).alias("title"), F.get(sections, (F.floor(F.col("doc_id") / n) % 3).cast("int")).alias("section"),
        F.col("content").alias("text"), F.when(F.col("doc_id") % 5 == 0, "table_summary").otherwise("text").alias("kind"),
    )


@query
def semantic_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rules.semantic_topic(F.col("title"), F.col("section"), F.col("text"))
    return _topical(spark, sf_dir).select("doc_id", t.alias("topic"), rules.low_value(t, F.col("text")).alias("low_value"), T.concise_title(t, F.col("title")).alias("title"))


@query
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rules.taxonomy(F.col("title"), F.lit(""), F.col("text"), F.col("section"))
    return _topical(spark, sf_dir).select("doc_id", t["primary_topic"].alias("primary_topic"), t["secondary_topic"].alias("secondary_topic"))


@query
def topic_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by title and whole text, for every section."""
    t = rules.semantic_topic(F.col("title"), F.col("section"), F.col("text"))
    return _topical(spark, sf_dir).select("doc_id", t.alias("topic"), rules.low_value(t, F.col("text")).alias("low_value"))


@query
def taxonomy_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary and secondary topics by topic, title and whole text."""
    both = lambda t: F.struct(t.alias("topic"), rules.taxonomy(t, F.col("title"), F.col("text"), F.col("section")).alias("x"))
    rows = _topical(spark, sf_dir).select("doc_id", T.let(rules.semantic_topic(F.col("title"), F.col("section"), F.col("text")), both).alias("t"))
    return rows.select("doc_id", "t.topic", "t.x.primary_topic", "t.x.secondary_topic")


@query
def quality_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topical(spark, sf_dir).select("doc_id", rules.quality_label(F.col("kind"), F.col("text")).alias("quality"))


@query
def topic_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.documents(spark, sf_dir).withColumn("topic", F.substring("title", 1, 12))
    both = T.join_topic(T.with_topic(F.col("content"), F.col("topic")), F.concat(F.upper("topic"), F.lit(" : x")), F.col("topic"))
    return d.select("doc_id", F.length(both).alias("n"), F.length(T.strip_topic(F.concat("topic", F.lit(":  "), F.col("title")), F.col("topic"))).alias("rest"))


@query
def prose_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).select("doc_id", F.size(T.prose_sentences(F.col("content"))).alias("sentences"))
