import random
import re

import pytest
from pyspark.sql import functions as F

from skein.functions import rules
from skein.operators import answering, chunking, embedding, evaluation, filing, retrieval, sampling
from skein.sources import index_store, jsonl
from skein.streaming import ingest


def spec_windows(text, size, overlap):
    text, out, at = text.strip(), [], 0
    while text:
        out.append(text[at : at + size].strip())
        if at + size >= len(text):
            break
        at += size - overlap
    return [t for t in out if t]


def test_windows(spark):
    rng = random.Random(1)
    texts = ["", "  ", "x" * 500, "x" * 501, "y" * 920, "z" * 921, "字" * 480, "\U0001f600" * 600, "a" + " " * 700 + "b"]
    texts += ["".join(rng.choice("ab  \n") for _ in range(rng.randrange(1500))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, content string")
    for config in (chunking.ChunkingConfig(), chunking.ChunkingConfig(7, 3)):
        got = {}
        for r in chunking.chunk_documents(df, config).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append((r.chunk_index, r.text))
            assert r.chunk_id == f"{r.doc_id}_chunk_{r.chunk_index}"
        for i, t in enumerate(texts):
            assert got.get(i, []) == list(enumerate(spec_windows(t, config.size, config.overlap)))
    with pytest.raises(ValueError):
        chunking.ChunkingConfig(5, 5)


def test_jsonl(spark, tmp_path):
    good = '{"doc_id":"1","title":" t ","source":"s","date":"d","category":"c","content":"x"}'
    lines = [good, "", good.replace('"1"', "5"), good.replace('"x"', '" "'), good.replace('"x"', "null"), '{"doc_id":"1"}', "{broken", "[1]"]
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    docs, rejects = jsonl.read_documents(spark, str(tmp_path / "d.jsonl"))
    assert [r.title for r in docs.collect()] == ["t"]
    assert sorted(r.reason for r in rejects.collect()) == sorted(["doc_id is no string", "empty content", "content is no string", "missing title", "malformed", "no object"])
    strict, _ = jsonl.read_documents(spark, str(tmp_path / "d.jsonl"), strict=True)
    with pytest.raises(Exception, match="doc_id is no string|empty content|missing|malformed|no object"):
        strict.collect()
    jsonl.write_jsonl(docs.withColumn("title", F.lit("é中 ")), str(tmp_path / "out"))
    again, none = jsonl.read_documents(spark, str(tmp_path / "out"))
    assert again.first().title == "é中" and none.count() == 0  # the separator is white space at the end


def test_chunk_forms(spark, tmp_path):
    filing_row = '{"id":"a_b_0007","company":"Co","doc_type":"10-K","filing_date":"2024","section":"S","primary_topic":"p","secondary_topic":"s","chunk_type":"","quality":"","title":"T","text":"x","source":"u"}'
    generic = '{"chunk_id":"c","doc_id":3,"title":"","source":"s","date":"d","chunk_index":2,"text":"x","quality":" "}'
    bad = [generic.replace("2,", '"2",'), generic.replace('"x"', '"  "'), filing_row.replace('"u"', "null")]
    (tmp_path / "c.jsonl").write_text("\n".join([filing_row, generic, *bad]))
    rows, rejects = jsonl.read_chunks(spark, str(tmp_path / "c.jsonl"))
    got = {r.chunk_id: r for r in rows.collect()}
    assert (got["a_b_0007"].chunk_index, got["a_b_0007"].doc_id, got["a_b_0007"].quality) == (7, "Co 10-K", "")
    assert (got["c"].doc_id, got["c"].chunk_type, got["c"].quality) == ("3", "text", "medium")
    assert sorted(r.reason for r in rejects.collect()) == ["chunk_index is no integer", "empty text", "missing source"]


def test_hashing_vectors(spark):
    import hashlib
    import math

    texts = ["Revenue grew, revenue fell", "", "中文 abc", "!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = embedding.HashingModel(16).vectors(df, "t").orderBy("i").collect()
    for r in got:
        want = [0.0] * 16
        for tok in "".join(c if c.isalnum() else " " for c in r.t.lower()).split():
            h = hashlib.sha256(tok.encode()).digest()
            want[int.from_bytes(h[:4], "big") % 16] += 1 if h[4] % 2 == 0 else -1
        norm = math.sqrt(sum(v * v for v in want)) or 1
        assert r.vector == pytest.approx([v / norm for v in want])
    with pytest.raises(ValueError):
        embedding.HashingModel(0)


def test_backends(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "i int, t string")
    model = embedding.BatchModel(lambda xs: [[float(len(x)), float(len(xs))] for x in xs], 2, batch_size=2)
    assert {tuple(r.vector)[0] for r in model.vectors(df.coalesce(1), "t").collect()} == {1.0, 2.0, 3.0}

    def broken(xs):
        raise embedding.EmbeddingError("EmbeddingError: down")

    both = embedding.FallbackModel(embedding.BatchModel(broken, 8), embedding.HashingModel(8))
    assert {r.embedding_provider for r in both.vectors(df, "t").collect()} == {"hashing"}
    assert isinstance(embedding.model_from_environment({}), embedding.HashingModel)
    remote = embedding.model_from_environment({"EMBEDDING_PROVIDER": "openai", "OPENAI_API_KEY": "k", "OPENAI_BASE_URL": "u", "EMBEDDING_BASE_URL": "v", "EMBEDDING_DIMENSION": "12"})
    assert isinstance(remote, embedding.FallbackModel) and remote.dimension == 12
    assert embedding.embedding_rows({"data": [{"embedding": [1, 2.5]}]}) == [[1.0, 2.5]]
    for bad in ({}, {"data": []}, {"data": [{"embedding": []}]}, {"data": [{"embedding": ["x"]}]}):
        with pytest.raises(embedding.EmbeddingError):
            embedding.embedding_rows(bad)


def chunk_rows(spark, rows):
    """(position, text, section, primary, quality)"""
    full = [(p, f"c{p}", f"d{p}", f"T{p}", "src", "2024", 0, t, "", "", s, pt, "", "text", ql) for p, t, s, pt, ql in rows]
    names = "position long, chunk_id string, doc_id string, title string, source string, date string, chunk_index int, text string, company string, doc_type string, section string, primary_topic string, secondary_topic string, chunk_type string, quality string"
    return spark.createDataFrame(full, names).withColumn("codes", embedding.signed_buckets(chunking.embedding_text()))


def asked(spark, *questions):
    df = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(questions)], "qid string, question string")
    return df.withColumn("codes", embedding.signed_buckets(F.col("question")))


def test_rerank_arithmetic(spark):
    chunks = chunk_rows(spark, [(1, "a", rules.BUSINESS, "business_segment", "high"), (2, "b", rules.BUSINESS, "", "high"), (3, "c", rules.RISK, "", "medium")])
    questions = spark.createDataFrame([("q1", "business segments"), ("q2", "its subsidiaries"), ("q3", "revenue and risk")], "qid string, question string")
    found = spark.createDataFrame([("q1", 1, 0.4302), ("q2", 2, 0.6233), ("q3", 3, 0.2711)], "qid string, position long, embedding_score double")
    got = {r.qid: r.score for r in retrieval.rerank(found, chunks, questions).collect()}
    assert got["q1"] == pytest.approx(0.3436, abs=1e-4) and got["q2"] == pytest.approx(0.4613, abs=1e-4)
    assert got["q3"] == pytest.approx(0.7 * 0.2711 + 0.15 * 0.2 + 0.05 * 0.02, abs=1e-9)


def test_search_both_ways_with_ties(spark):
    rows = [(i, t, "", "", "high") for i, t in enumerate(["alpha beta", "alpha beta", "gamma", "alpha", "delta epsilon zeta"])]
    chunks = chunk_rows(spark, rows).withColumn("codes", embedding.signed_buckets(F.col("text")))
    questions = asked(spark, "alpha beta", "gamma delta")
    dense = retrieval.search(questions, chunks, 2).select("qid", "rank", "position").orderBy("qid", "rank").collect()
    assert [(r.qid, r.position) for r in dense] == [("q0", 0), ("q0", 1), ("q1", 2), ("q1", 4)]
    old, retrieval.MOST_QUESTIONS = retrieval.MOST_QUESTIONS, 0
    try:
        postings = retrieval.search(questions, chunks, 2).select("qid", "rank", "position").orderBy("qid", "rank").collect()
    finally:
        retrieval.MOST_QUESTIONS = old
    assert postings == dense
    assert retrieval.search(questions, chunks.limit(0), 2).collect() == []
    with pytest.raises(ValueError):
        retrieval.search(questions, chunks, 0)


def test_answers(spark):
    chunks = chunk_rows(spark, [(1, "Loan margins widened; rates rose\nOther line", rules.MDA, "", "high"), (2, "苹果公司营收增长。其他内容", rules.BUSINESS, "", "medium")])
    questions = asked(spark, "Why did loan margins widen?", "苹果公司营收如何?", "zzz qqq", "what is the")
    found = retrieval.retrieve(questions, chunks, 2)
    got = {r.qid: r for r in answering.answer(questions, found).collect()}
    assert got["q0"].answer == "Loan margins widened;" and got["q0"].sources == ["T1 (src, 2024)"]
    assert got["q1"].evidence[0] == "苹果公司营收增长。"
    assert got["q2"].answer == got["q3"].answer == answering.INSUFFICIENT and got["q2"].sources == []
    none = answering.answer(questions, retrieval.retrieve(questions, chunks.limit(0)))
    assert {r.answer for r in none.collect()} == {answering.INSUFFICIENT}


def test_parse_and_ground(spark):
    context = spark.createDataFrame([("q", 1, "Title", "src", "2024", "The loan book grew fast; it is large")], "qid string, context_rank int, title string, source string, date string, text string")
    raws = {
        "plain": "It grew.", "blank": "  ", "no": "Answer: insufficient information Sources:\n- x Evidence: 1. y",
        "full": "answer:\nThe loan book grew\nSources:\n- Title (src, 2024)\n- see Title now\n- other\nEvidence:\n1. loan book grew fast\n2. unrelated words\n3. The loan",
        "wrong": "Answer: loan\nSources:\n- other\nEvidence:\n1. unrelated words",
    }
    for name, raw in raws.items():
        r = answering.grounded(spark.createDataFrame([("q", raw)], "qid string, raw string"), context).first()
        want = {
            "plain": ("It grew.", ["Title (src, 2024)"], ["The loan book grew fast;", "it is large"]),
            "blank": (answering.INSUFFICIENT, [], []), "no": (answering.INSUFFICIENT, [], []),
            "full": ("The loan book grew", ["Title (src, 2024)", "see Title now"], ["loan book grew fast", "The loan"]),
            "wrong": ("loan", ["Title (src, 2024)"], ["The loan book grew fast;"]),
        }[name]
        assert (r.answer, r.sources, r.evidence) == want, name
    row = spark.createDataFrame([("a", [], []), ("b", ["s"], ["x", "y"])], "a string, s array<string>, e array<string>")
    shown = [r[0] for r in row.select(answering.formatted(F.col("a"), F.col("s"), F.col("e"), display=True)).collect()]
    assert shown == ["Answer:\na\n\nSources:\n- None\n\nEvidence:\n1. insufficient information", "Answer:\nb\n\nSources:\n- s\n\nEvidence:\n1. x\n2. y"]


def test_evaluation_reports(spark):
    cases = evaluation.cases(spark.createDataFrame([("1", "q?", "a b c d")], "qid string, question string, reference_answer string"))
    answers = spark.createDataFrame([("1", "a b x", ["s"], ["e"])], "qid string, answer string, sources array<string>, evidence array<string>")
    rows = evaluation.results(cases, answers)
    assert rows.first().lexical_overlap == 0.5
    text = evaluation.report(rows)
    assert "- avg_lexical_overlap_vs_reference: 0.500" in text and "[1] q?" in text and "- hallucination: TODO" in text
    assert evaluation.report(rows.limit(0)) == "No eval results."
    s = evaluation.summary(rows.limit(0)).first()
    assert (s.case_count, s.avg_lexical_overlap) == (0, 0.0)

    def missing():
        raise LookupError("not configured")

    def broken():
        raise ValueError("dimension")

    both, status = evaluation.compare({"hash": lambda: rows, "remote": missing, "bad": broken})
    assert [(n, s) for n, s, _ in status] == [("hash", "ok"), ("remote", "skipped"), ("bad", "failed")]
    report = evaluation.comparison_report(both, status)
    assert "| hash | ok | 1 | 1 | 0.500 | 1.00 |" in report and "| remote | skipped |" in report


def test_greedy_sample(spark):
    rng = random.Random(3)
    rows = [(i, f"d{i}", f"t{rng.randrange(25)}", "s", "d", rng.choice(["macro", "equity", "policy", "general"]), "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "line long, doc_id string, title string, source string, date string, category string, content string")
    for per, most in ((5, 20), (2, 5), (9, 12)):
        taken, titles, count = [], set(), {}
        for r in rows:
            if len(taken) < most and r[5] != "general" and r[2] not in titles and count.get(r[5], 0) < per:
                taken.append(r[0])
                titles.add(r[2])
                count[r[5]] = count.get(r[5], 0) + 1
        assert sorted(r.line for r in sampling.sample_articles(docs, per, most).collect()) == taken


def test_line_numbers_and_dates(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\n\nb")
    assert [tuple(r) for r in sampling.line_numbers(str(tmp_path / "x.txt"), spark).collect()] == [(1, "a"), (2, ""), (3, "b")]
    df = spark.createDataFrame([("2024-01-02T03:04:05",), ("2024-01-02",), ("Jan 2, 2024 x",)], "t string")
    assert [r[0] for r in df.select(sampling.iso_date(F.col("t"))).collect()] == ["2024-01-02", "2024-01-02", "Jan 2, 202"]


def test_html_blocks(spark):
    pages = [
        (1, "<html><head><meta charset=utf-8><title>no</title></head><body><p>One<br>two <b>x</b></p><script>a</p>b</script><table><tr><td>c1</td><td> </td><td>c2</td></tr></table><div style='display: none'>h<p>i</p></div><div hidden>shown</div><div hidden='hidden'>no</div>end"),
        (2, "<html><head><meta charset='utf-8'/></head><body><p>A&amp;B C</p><hr/></body></html>"), (3, None), (4, ""),
    ]
    got = {}
    for r in filing.html_blocks(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id", "ordinal").collect():
        got.setdefault(r.page_id, []).append((r.text, r.in_table))
    assert got == {1: [("One", False), ("two x", False), ("c1", True), ("c2", True), ("shown", False), ("end", False)], 2: [("A&B C", False)]}


def _sectioned(spark, section, rows):
    """Chunks of blocks (clean, in_table, heading) of one section."""
    df = spark.createDataFrame([("d", section, i, c, t, c, False, False, h) for i, (c, t, h) in enumerate(rows)], "doc string, section string, ordinal int, text string, in_table boolean, clean string, skip boolean, skip_clean boolean, heading boolean")
    return filing.section_chunks(df).orderBy("number").collect()


def test_section_fold(spark):
    long = "word " * 99 + "word."  # 500 characters
    rows = [("p1", False, False), *[(f"c{i % 9}", True, False) for i in range(10)], *[(long, False, False)] * 3, ("Risky " + "risk " * 20 + ".", False, True), ("cell", True, False)]
    got = [(r.kind, r.title, r.text.count("\n") + 1) for r in _sectioned(spark, rules.RISK, rows)]
    assert got == [("table_summary", rules.RISK, 1), ("text", rules.RISK, 3), ("text", rules.RISK, 1), ("text", "Risky " + "risk " * 20, 1)]
    words = " and more words of it" * 5
    got = _sectioned(spark, rules.BUSINESS, [("Overview", False, True), *[(p + words, False, False) for p in "abc"]])
    assert [(r.title, r.topic, r.text) for r in got] == [
        ("Overview", "Firm business overview", f"Firm business overview: a{words}"),
        ("Subsidiaries and structure", "Subsidiaries and operating structure", f"Subsidiaries and operating structure: b{words}\nc{words}"),
    ]


def _value(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_cells(spark):
    cells = [("a", False), ("a", False), ("x", True), ("a", False), ("$", False), ("b", False), ("a", False), ("l" * 200, False)]
    kind = "c array<struct<clean:string,skip_clean:boolean>>"
    assert _value(spark, filing.compact_cells(F.col("c")), kind, cells) == ["a", "b", "a", "l" * 177 + "..."]
    cut = "l" * 177 + "..."  # a long cell isn't equal to its shortened form, but what is equal to that repeats it
    assert _value(spark, filing.compact_cells(F.col("c")), kind, [("l" * 200, False), ("l" * 200, False), (cut, False), (cut, False)]) == [cut, cut]
    shown = _value(spark, filing.shown_cells(F.col("c")), "c array<string>", ["x" * 100] * 40)
    assert len("; ".join(shown)) <= 1080 < len("; ".join([*shown, "x" * 100]))
    assert len(_value(spark, filing.shown_cells(F.col("c")), "c array<string>", ["x"] * 50)) == 35


def test_split_and_merge(spark):
    units = [f"Sentence number {i} " + "x" * 200 + "." for i in range(12)]
    split = filing.split_text(F.col("t"), F.col("u"), F.lit("Topic"))
    parts = _value(spark, split, "t string, u array<string>", " ".join(units), units)
    assert all(p.startswith("Topic: ") for p in parts) and max(map(len, parts)) <= 1200 + 10
    assert "".join(parts).count("Sentence number") == 12
    assert _value(spark, split, "t string, u array<string>", "short", []) == ["short"]
    alone = _value(spark, split, "t string, u array<string>", "x" * 1600, ["a", "y" * 1600, "b", "c"])
    assert [len(p) for p in alone] == [8, 1607, 10]  # a sentence over the hard size is a part alone
    c = lambda text, topic="T", kind="text": ("S", kind, "title", topic, text)
    rows = [c("T: a"), c("T: " + "b" * 400), c("T: c"), c("U: lost", "U"), c("t", "T", "table_summary"), c("T: alone")]
    merged = _value(spark, filing.merge_tiny(F.col("p")), f"p array<{filing._PART}>", rows)
    assert [m.text for m in merged] == ["T: a\n" + "b" * 400 + "\nc", "t"]
    assert _value(spark, filing.merge_tiny(F.col("p")), f"p array<{filing._PART}>", []) == []


def test_filing_end_to_end(spark):
    text = " ".join(f"Operations worldwide sentence {i} has some words." for i in range(60))
    blocks = [("Item 1. Business.", False), ("Overview", False), ("First paragraph " + "about operations worldwide and more words " * 8, False), (text, False), *[(f"cell {i} value", True) for i in range(12)], ("Part I", False), ("Competition", False), ("We face competition " + "in every market we serve today " * 12, False)]
    df = spark.createDataFrame([("d", rules.BUSINESS, i, t, b) for i, (t, b) in enumerate(blocks)], "doc string, section string, ordinal int, text string, in_table boolean")
    out = filing.postprocess(filing.section_chunks(filing.flagged(df))).orderBy("id").collect()
    assert [r.id for r in out] == [f"d_item1_{i:04d}" for i in range(1, len(out) + 1)]
    assert {r.chunk_type for r in out} == {"text", "table_summary"} and any(r.primary_topic == "competition" for r in out)
    assert all(len(r.text) <= 1500 for r in out)
    with pytest.raises(Exception, match="unknown section"):
        filing.labelled(spark.createDataFrame([("d", 0, "Nope", "text", "t", "t", "x")], "doc string, place int, section string, kind string, title string, topic string, text string")).collect()


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "t", "s", "d", "c", "word " * (i * 60 + 1)) for i in range(6)], "doc_id string, title string, source string, date string, category string, content string")
    chunks = chunking.chunk_records(chunking.chunk_documents(docs))
    meta = index_store.build(chunks, str(tmp_path / "index"))
    rows = index_store.load(spark, str(tmp_path / "index"), 256)
    got = rows.orderBy("position").collect()
    assert [r.position for r in got] == list(range(int(meta["chunk_count"])))
    assert [(r.doc_id, r.chunk_index) for r in got] == sorted((r.doc_id, r.chunk_index) for r in got)
    with pytest.raises(ValueError, match="dimension"):
        index_store.load(spark, str(tmp_path / "index"), 16)
    with pytest.raises(ValueError, match="more than once"):
        index_store.build(chunks.unionByName(chunks), str(tmp_path / "twice"))


def test_streaming_ingest(spark, tmp_path):
    schema = "doc_id string, title string, source string, date string, category string, content string"
    docs = spark.createDataFrame([("a", "t", "s", "d", "c", "x" * 900), ("b", "t", "s", "d", "c", "yy")], schema)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = index_store.load(spark, str(tmp_path / "out"))
    want = ingest.prepared(docs)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 3


def test_cases_file(spark, tmp_path):
    jsonl.write_cases(spark.createDataFrame([("q1", "why?")], "qid string, question string"), str(tmp_path / "a" / "cases.json"))
    assert [tuple(r) for r in jsonl.read_cases(spark, str(tmp_path / "a" / "cases.json")).select("qid", "question", "task_type", "position").collect()] == [("q1", "why?", "qa", 0)]


def test_topic_queries_read_whole_texts(spark, tmp_path):
    from skein.plans import queries

    titles = len(rules.TOPIC_RULES) + len(rules.RISK_TOPICS) + 5
    plain = titles - 2  # its title holds no needle
    needle = rules.PRIORITY_TOPICS[0]
    group, words = rules.FINANCIAL[0]
    long = "xyz " * 500 + f"{needle[0]} {words[0]} the following is a discussion"
    spark.createDataFrame([(plain, long, "en", "s", len(long))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(queries._topical(spark, str(tmp_path)).first().text) == len(long)
    got = queries.semantic_topic(spark, str(tmp_path)).first()
    assert got.topic == needle[1] and got.low_value
    t = queries._topical(spark, str(tmp_path))
    one = t.select(rules.taxonomy(t.title, F.lit(""), t.text, t.section).alias("t")).first().t
    out = queries.taxonomy(spark, str(tmp_path)).first()
    assert (out.primary_topic, out.secondary_topic) == (one.primary_topic, one.secondary_topic)
    cut = t.select(rules.taxonomy(t.title, F.lit(""), F.lit(""), t.section).alias("t")).first().t
    assert (cut.primary_topic, cut.secondary_topic) != (one.primary_topic, one.secondary_topic)


def test_search_both_ways_with_few_or_negative_matches(spark):
    rows = [(i, t, "", "", "high") for i, t in enumerate(["alpha beta", "gamma", "", "delta epsilon zeta", "alpha", *[f"w{i}" for i in range(40)]])]
    chunks = chunk_rows(spark, rows).withColumn("codes", embedding.signed_buckets(F.col("text"), 16))
    questions = asked(spark, "alpha", "...", "nothing of these", "w3 w4 w5").withColumn("codes", embedding.signed_buckets(F.col("question"), 16))
    ask = lambda: [tuple(r) for r in retrieval.search(questions, chunks, 20, 16).select("qid", "rank", "position", "embedding_score").orderBy("qid", "rank").collect()]
    dense = ask()
    assert len(dense) == 80
    for most in (0, 1, 3):
        old, retrieval.MOST_QUESTIONS = retrieval.MOST_QUESTIONS, most
        try:
            assert ask() == dense
        finally:
            retrieval.MOST_QUESTIONS = old


@pytest.mark.parametrize(("size", "overlap"), [(500, 80), (10, 0), (10, 9), (7, 4), (1, 0)])
def test_windows_match_slices(spark, size, overlap):
    config = chunking.ChunkingConfig(size, overlap)
    texts = ["", " \t", "a", "x" * size, "x" * (size + 1), "ab  c\n" * 300, "  é𝄞 词" * 200 + " ", None]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", chunking.windows(F.col("t"), config).alias("w")).collect()
    for r in got:
        body, want = (texts[r.n] or "").strip(), []
        for at in range(0, len(body), size - overlap):
            want.append(body[at : at + size].strip())
            if at + size >= len(body):
                break
        assert r.w == [w for w in want if w], r.n


def test_small_tables_in_few_files_are_dealt_to_all_cores(spark, tmp_path):
    from skein.storage import read_table

    rows = spark.range(100).withColumn("text", F.lit("x"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    rows.repartition(6).write.parquet(f"{tmp_path}/six")
    rows.limit(0).coalesce(1).write.parquet(f"{tmp_path}/none")
    parts = lambda df: {r.p for r in df.select(F.spark_partition_id().alias("p")).collect()}
    one = read_table(spark, f"{tmp_path}/one", "id")
    assert len(parts(one)) > 4 and sorted(r.id for r in one.collect()) == list(range(100))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan(one)
    scan = one.select("id").where("id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in scan and "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in scan
    assert "Repartition" not in plan(read_table(spark, f"{tmp_path}/six", "id")) and "Repartition" not in plan(read_table(spark, f"{tmp_path}/one"))
    assert read_table(spark, f"{tmp_path}/none", "id").collect() == []


def test_bucket_sums_of_rows_that_share_a_key(spark, monkeypatch, tmp_path):
    texts = [(1, "a b a"), (1, "c ü"), (2, None), (3, "..."), (None, "x"), (None, "x y"), (5, "w " * 5000), *[(7, f"t{i} u") for i in range(5000)]]
    spark.createDataFrame(texts, "doc_id long, t string").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(embedding, "TASK_BYTES", max(1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // 37))
    got = embedding.bucket_sums(df, "doc_id", "t", 8)
    want = df.select("doc_id", F.explode(embedding.signed_buckets(F.col("t"), 8)).alias("c")).groupBy("doc_id", (F.abs("c") - 1).cast("long").alias("bucket")).agg(F.sum(F.signum("c")).cast("long").alias("value"))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(got) == key(want)
    # Tasks follow the bytes of the input, so what one holds doesn't grow with it.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"hashpartitioning\(k#\d+L?, (\d+)\)", plan)[1]) in (37, 38) and "HashAggregate" not in plan


def test_search_hashes_tokens_and_sends_few_rows(spark, monkeypatch):
    rows = [(i, f"w{i % 50} w{i % 7} common", "", "", "high") for i in range(400)]
    chunks, q = chunk_rows(spark, rows).coalesce(1), asked(spark, "w3 common", "w5 w2", "nothing", "w11 w4 common")
    told = chunks.withColumn("codes", embedding.word_tokens(F.col("text"))), q.withColumn("codes", embedding.word_tokens(F.col("question")))
    coded = chunks.withColumn("codes", embedding.signed_buckets(F.col("text")))
    ask = lambda c, q: [tuple(r) for r in retrieval.search(q, c, 5).select("qid", "rank", "position", "embedding_score").orderBy("qid", "rank").collect()]
    want = ask(coded, q)
    assert len(want) == 20 and ask(*told) == want

    def no(*a, **b):
        raise AssertionError

    with monkeypatch.context() as m:  # more questions than are broadcast at once: rounds, not blocks
        m.setattr(retrieval, "search_blocks", no)
        m.setattr(retrieval, "MOST_QUESTIONS", 2)
        assert ask(*told) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        monkeypatch.setattr(retrieval, "_best", lambda df, k: df)
        assert retrieval.search(q, coded, 5).count() == 20  # a task sends its best once, not those of each batch
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_the_search_deals_documents_in_tasks_that_follow_the_input(spark, monkeypatch):
    from skein.plans import tables

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(tables, "DEALT", 1 << 12)
    few = tables.chunks(spark, folder).select("chunk_id", "text")
    many = tables.chunks(spark, folder, deal=True).select("chunk_id", "text")
    assert tables.indexed(spark, folder).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_plain_texts_are_hashed_without_the_pattern(spark):
    """Tokens of texts whose bytes beyond ASCII are all of letters are found in numpy; the pattern makes the others'."""
    import numpy as np

    from skein.functions import text as T
    from skein.plans import tables

    texts = ["", "Plain words, 12 of_them\n\x00x", "École ÀÉÎ straße ÿ ſ ǅ", "a×b÷c", "’quoted’ — words", "İstanbul ΣΑΣ ὀδός", "Ёлка-42", "中文 abc中", "x²y ½ ªº", "e\u0301", "🙂 smile", "a\u00a0b", "٣ n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = rows.select("id", T.plain_or_tokens(F.col("text")).alias("v"), T.word_tokens(F.col("text")).alias("tokens")).orderBy("id").toArrow()
    for column in (got.column("v"), got.slice(3).column("v"), got.slice(0, 3).column("v"), got.slice(0, 0).column("v")):
        first = len(texts) - len(column) if len(column) > 3 else 0
        codes, size = embedding._flat_codes(column, 64)
        want, n = embedding._flat_codes(got.column("tokens").slice(first, len(column)), 64)
        assert list(size) == list(n) and (codes == want).all() and np.sum(size) == len(codes)
    plain = [r["plain"] is not None for r in got.column("v").to_pylist()]
    assert plain == [True, True, True, False, False, False, True, True, False, False, False, False, False]
    assert set(tables.indexed(spark, "/root/testdata/sf0.001").schema["codes"].dataType.names) == {"plain", "tokens"}
