import json

import pytest

from pyspark.sql import functions as F

from skein import cli
from skein.operators import embedding, filing, generation
from skein.sources import jsonl


def test_verbs(spark, tmp_path):
    docs = [{"doc_id": f"d{i}", "title": f"Title {i}", "source": "src", "date": "2024", "category": "c", "content": t} for i, t in enumerate(["Loan margins widened; rates rose", "Costs fell; staff grew", "苹果营收增长。"])]
    (tmp_path / "docs.jsonl").write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs), encoding="utf-8")
    (tmp_path / "cases.json").write_text(json.dumps([{"qid": "1", "question": "Why did loan margins widen?", "reference_answer": "Loan margins widened"}, {"qid": "2", "question": "zzz"}]))
    at = lambda name: str(tmp_path / name)
    assert cli.main(["build-chunks", "--documents", at("docs.jsonl"), "--output", at("chunks")], spark) == "chunks: 3"
    assert "chunk_count: 3" in cli.main(["build-index", "--chunks", at("chunks"), "--index", at("index")], spark)
    out = cli.main(["ask", "Why did loan margins widen?", "--index", at("index"), "--debug", "--show-prompt"], spark)
    assert out.startswith("Answer:\nLoan margins widened;") and "- Title 0 (src, 2024)" in out and "- 1. score=" in out and "[Question]\nWhy did loan" in out
    assert "insufficient information" in cli.main(["ask", "zzz", "--index", at("index")], spark)
    report = cli.main(["eval", "--cases", at("cases.json"), "--index", at("index")], spark)
    assert "- cases: 2" in report and "[1] Why did" in report and "Lexical Overlap: 1.000" in report
    assert "- cases: 1" in cli.main(["eval", "--cases", at("cases.json"), "--index", at("index"), "--limit", "1"], spark)
    assert "hashing" in cli.main(["backend"], spark)


def test_generators(spark):
    context = spark.createDataFrame([("q", 1, "c", "T", "src", "2024", "Loans grew fast; more", "", "", "")], "qid string, context_rank int, chunk_id string, title string, source string, date string, text string, section string, primary_topic string, secondary_topic string")
    questions = spark.createDataFrame([("q", "loans grew?")], "qid string, question string")
    remote = generation.Remote(lambda prompts: ["Answer: yes Sources:\n- T Evidence:\n1. Loans grew" for _ in prompts])
    assert remote.raw(questions, context).first().raw.startswith("Answer: yes")

    def down(prompts):
        raise generation.LLMGenerationError("LLMGenerationError: down")

    out = generation.Fallback(generation.Remote(down), generation.Extractive()).raw(questions, context).first().raw
    assert out.startswith("Answer:\nLoans grew fast;")
    assert isinstance(generation.generator_from_environment({}), generation.Extractive)
    assert isinstance(generation.generator_from_environment({"OPENAI_BASE_URL": "u", "OPENAI_API_KEY": "k", "OPENAI_MODEL": "m"}), generation.Fallback)


@pytest.mark.parametrize(
    ("payload", "text"),
    [({"choices": [{"message": {"content": " a "}}]}, "a"), ({"choices": [{"message": {"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}}]}, "ab"), ({"choices": [{"text": "c"}]}, "c"), ({}, None), ({"choices": []}, None), ({"choices": [{"message": {"content": ""}}]}, None)],
)
def test_message_text(payload, text):
    if text is None:
        with pytest.raises(generation.LLMGenerationError):
            generation.message_text(payload)
    else:
        assert generation.message_text(payload) == text


PARAGRAPHS = {
    "Item 1. Business.": "The company is a leading financial services firm with operations worldwide and many clients in every region it serves, and it offers deposits, loans and payments to them. " * 3,
    "Item 1A. Risk Factors.": "Cyber attacks could harm the technology and the data of the firm, and its operations may suffer when vendors fail to protect what they were given to keep safe. " * 3,
    "Item 1B. Unresolved Staff Comments.": "None of these were left at the end of the year.",
    "Management's discussion and analysis": "The following is Management's discussion and analysis of the year. Net revenue rose as deposits grew, and expense fell because the number of branches was reduced in several regions. " * 3,
    "Management's report on internal control over financial reporting": "After it.",
}

MORE = {"Management's discussion and analysis": "<p>Liquidity</p><p>" + "The firm held cash and deposits at central banks to meet what it owes in a stress of thirty days, as it did in the year before. " * 4 + "</p>"}


def filing_page(skip=()):
    return "<html><head><title>x</title></head><body><p>Cover</p>" + "".join(f"<p>{h}</p><p>{p}</p>" + MORE.get(h, "") for h, p in PARAGRAPHS.items() if h not in skip) + "</body></html>"


def test_prepare_filing(spark, tmp_path):
    (tmp_path / "bank.htm").write_bytes(filing_page().encode() + b"\xff")
    args = ["prepare-filing", "--input", str(tmp_path / "bank.htm"), "--output", str(tmp_path / "chunks"), "--company", "Bank", "--doc-type", "10-K", "--filing-date", "2024-02-01"]
    out = cli.main(args, spark)
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "chunks")).collect()]
    assert out.startswith(f"chunks: {len(rows)}\n") and all(f"- {s}: " in out for s in ("Item 1 Business", "Item 1A Risk Factors", "Item 7 MD&A"))
    assert {r["section"] for r in rows} == {"Item 1 Business", "Item 1A Risk Factors", "Item 7 MD&A"}
    assert {r["id"].rsplit("_", 1)[0] for r in rows} == {"bank_item1", "bank_item1a", "bank_item7"}
    assert all(r["company"] == "Bank" and r["filing_date"] == "2024-02-01" and r["chunk_type"] == "text" for r in rows)
    assert all("None of these" not in r["text"] and "After it" not in r["text"] and "Cover" not in r["text"] for r in rows)
    assert next(r for r in rows if r["section"] == "Item 1A Risk Factors")["primary_topic"] == "operational_risk"
    chunks, _ = jsonl.read_chunks(spark, str(tmp_path / "chunks"), strict=True)
    assert {r.doc_id for r in chunks.collect()} == {"Bank 10-K"}
    (tmp_path / "part.htm").write_text(filing_page(["Item 1A. Risk Factors."]))
    with pytest.raises(ValueError, match="Item 1 Business"):
        cli.main(["prepare-filing", "--input", str(tmp_path / "part.htm"), "--output", str(tmp_path / "none")], spark)


def test_filings_without_a_section_keep_the_others(spark):
    pages = spark.createDataFrame([(1, filing_page()), (2, filing_page(["Management's discussion and analysis"])), (3, "<p>nothing</p>"), (4, None)], "page int, html string")
    got = filing.filings(pages, "page").groupBy("page").agg(F.collect_set("section").alias("s")).collect()
    assert {r.page: len(r.s) for r in got} == {1: 3, 2: 2}


def test_prepare_samples(spark, tmp_path):
    article = lambda i, title, text: json.dumps({"id": f"a{i}", "title": title, "text": text, "source": "", "time": "2024-05-06T01:02:03"})
    long = "GDP growth " + "and more words of it " * 12
    (tmp_path / "articles.jsonl").write_text("\n".join([article(1, "gdp one", long), "", article(2, "gdp one", long), article(3, "gdp two", "short"), article(4, "gdp three", long)]))
    assert cli.main(["prepare-demo", "--input", str(tmp_path / "articles.jsonl"), "--output", str(tmp_path / "demo")], spark) == "documents: 2"
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "demo")).collect()]
    assert sorted((r["doc_id"], r["source"], r["date"]) for r in rows) == [("demo_0001", "unknown", "2024-05-06"), ("demo_0005", "unknown", "2024-05-06")]
    said = lambda q, a: json.dumps({"conversations": [{"role": "system", "content": "s"}, {"role": "user", "content": q}, {"role": "assistant", "content": a}]})
    question, answer = "What did the bank earn in the year?", "The bank earned more than in the year before it."
    (tmp_path / "qa.jsonl").write_text("\n".join([said(question, answer), said("short", answer), said(question, answer), said(question + "?", answer)]))
    assert cli.main(["prepare-cases", "--input", str(tmp_path / "qa.jsonl"), "--output", str(tmp_path / "cases.json")], spark) == "cases: 2"
    cases = json.loads((tmp_path / "cases.json").read_text())
    assert [(c["qid"], c["question"], c["source_dataset"]) for c in cases] == [("q1", question, "qa.jsonl"), ("q2", question + "?", "qa.jsonl")]


def test_compare_and_an_index_of_another_model(spark, tmp_path, monkeypatch):
    docs = [{"doc_id": f"d{i}", "title": f"Title {i}", "source": "src", "date": "2024", "category": "c", "content": t} for i, t in enumerate(["Loan margins widened; rates rose", "Costs fell; staff grew"])]
    (tmp_path / "docs.jsonl").write_text("\n".join(json.dumps(d) for d in docs))
    (tmp_path / "cases.json").write_text(json.dumps([{"qid": "1", "question": "Why did loan margins widen?", "reference_answer": "Loan margins widened"}]))
    at = lambda name: str(tmp_path / name)
    cli.main(["build-chunks", "--documents", at("docs.jsonl"), "--output", at("chunks")], spark)
    out = cli.main(["compare", "--chunks", at("chunks"), "--cases", at("cases.json"), "--output", at("r/report.md")], spark)
    assert "| hashing | ok | 1 | 1 |" in out and "| configured | skipped |" in out and (tmp_path / "r" / "report.md").read_text() == out

    # A model that only knows whether a text speaks of costs or of loans.
    model = embedding.BatchModel(lambda texts: [[float("ost" in t), float("oan" in t)] for t in texts], 2, "stub", "two words")
    monkeypatch.setattr(cli, "model_from_environment", lambda: model)
    assert "provider: stub" in cli.main(["build-index", "--chunks", at("chunks"), "--index", at("index")], spark)
    out = cli.main(["ask", "And the costs?", "--index", at("index"), "--top-k", "1", "--debug"], spark)
    assert "title=Title 1" in out and "embedding=1.0000" in out
    out = cli.main(["compare", "--chunks", at("chunks"), "--cases", at("cases.json")], spark)
    assert "| configured | ok | 1 | 1 |" in out

    def down(texts):
        raise embedding.EmbeddingError("EmbeddingError: down")

    monkeypatch.setattr(cli, "model_from_environment", lambda: embedding.BatchModel(down, 2, "stub", "none"))
    assert "| configured | failed |" in cli.main(["compare", "--chunks", at("chunks"), "--cases", at("cases.json")], spark)
    local = embedding.model_from_environment({"EMBEDDING_PROVIDER": "local", "EMBEDDING_MODEL": "m", "EMBEDDING_DIMENSION": "4"})
    texts = spark.createDataFrame([("a b",)], "t string")
    got = local.vectors(texts, "t").first()
    assert len(got.vector) == 4 and got.embedding_provider == "hashing"
