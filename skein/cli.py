"""Command line: build-chunks, build-index, ask, eval, compare, prepare-filing, prepare-demo, prepare-cases, backend."""

from __future__ import annotations

import argparse
import pathlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import answering, chunking, evaluation, filing, generation, retrieval, sampling
from skein.operators.embedding import HashingModel, model_from_environment, signed_buckets
from skein.sources import index_store, jsonl
from skein.sources.pages import read_pages
from skein.storage import Scratch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    sub = p.add_subparsers(dest="verb", required=True)
    a = sub.add_parser("build-chunks")
    a.add_argument("--documents", required=True)
    a.add_argument("--output", required=True)
    a = sub.add_parser("build-index")
    a.add_argument("--chunks", required=True)
    a.add_argument("--index", required=True)
    a = sub.add_parser("ask")
    a.add_argument("question")
    a.add_argument("--index", required=True)
    a.add_argument("--top-k", type=int, default=retrieval.TOP_K)
    a.add_argument("--debug", action="store_true")
    a.add_argument("--show-prompt", action="store_true")
    a = sub.add_parser("eval")
    a.add_argument("--cases", required=True)
    a.add_argument("--index", required=True)
    a.add_argument("--top-k", type=int, default=retrieval.TOP_K)
    a.add_argument("--limit", type=int)
    a = sub.add_parser("compare")
    a.add_argument("--chunks", required=True)
    a.add_argument("--cases", required=True)
    a.add_argument("--output")
    a.add_argument("--top-k", type=int, default=retrieval.TOP_K)
    a.add_argument("--limit", type=int)
    a = sub.add_parser("prepare-filing")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    for name in ("company", "doc-type", "filing-date"):
        a.add_argument(f"--{name}", default="")
    for name in ("prepare-demo", "prepare-cases"):
        a = sub.add_parser(name)
        a.add_argument("--input", required=True)
        a.add_argument("--output", required=True)
    sub.add_parser("backend")
    return p


def _found(spark: SparkSession, questions, index: str, k: int, model=None):
    """The chunks of an index for questions, embedded as the index is."""
    meta = index_store.metadata(spark, index)
    if meta.get("provider", "hashing") == "hashing":
        dimension = int(meta.get("dimension", "256"))
        q = questions.withColumn("codes", signed_buckets(F.col("question"), dimension))
        return retrieval.retrieve(q, index_store.load(spark, index, dimension), k, dimension)
    model = model or model_from_environment()
    return retrieval.retrieve(model.vectors(questions, "question"), index_store.load(spark, index, model.dimension), k)


def _evaluated(spark: SparkSession, path: str, limit: int | None, index: str, k: int, model=None):
    cases = jsonl.read_cases(spark, path)
    cases = cases.orderBy("position").limit(limit) if limit is not None else cases
    found = _found(spark, cases.select("qid", "question"), index, k, model)
    lines = found.groupBy("qid").agg(answering.ordered(answering.debug_line(), F.col("rank")).alias("retrieved"), F.min_by("title", "rank").alias("top_title"))
    return evaluation.results(cases, generation.respond(cases.select("qid", "question"), found)).join(lines, "qid", "left")


def _backends(spark: SparkSession, args) -> dict:
    """Hashing and the configured model, each with an index of its own."""
    chunks, _ = jsonl.read_chunks(spark, args.chunks, strict=True)
    scratch = Scratch(spark)

    def run(name: str, model):
        if model is None:
            raise LookupError("no configuration")
        index = f"{scratch.root}/{name}"
        index_store.build(chunks, index, model)
        return scratch.save(_evaluated(spark, args.cases, args.limit, index, args.top_k, model), f"{name}_results")

    configured = model_from_environment()
    other = None if isinstance(configured, HashingModel) else configured
    return {"hashing": lambda: run("hashing", HashingModel()), "configured": lambda: run("configured", other)}


def _write(path: str, text: str) -> None:
    pathlib.Path(path).parent.mkdir(parents=True, exist_ok=True)
    pathlib.Path(path).write_text(text, encoding="utf-8")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a verb, prints its output and gives it back."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("skein").getOrCreate()
    if args.verb == "build-chunks":
        docs, _ = jsonl.read_documents(spark, args.documents, strict=True)
        jsonl.write_jsonl(chunking.chunk_records(chunking.chunk_documents(docs)), args.output)
        out = f"chunks: {spark.read.text(args.output).count()}"
    elif args.verb == "build-index":
        chunks, _ = jsonl.read_chunks(spark, args.chunks, strict=True)
        out = "\n".join(f"{k}: {v}" for k, v in index_store.build(chunks, args.index, model_from_environment()).items())
    elif args.verb == "ask":
        questions = spark.createDataFrame([("q", args.question)], "qid string, question string")
        found = _found(spark, questions, args.index, args.top_k)
        a = generation.respond(questions, found, generation.generator_from_environment())
        out = a.select(answering.formatted(F.col("answer"), F.col("sources"), F.col("evidence"), display=True)).first()[0]
        if args.debug:
            lines = [r[0] for r in found.orderBy("rank").select(answering.debug_line()).collect()] or ["- None"]
            out += "\n\nRetrieved Chunks:\n" + "\n".join(lines)
        if args.show_prompt:
            out += "\n\nPrompt:\n" + answering.prompts(answering.select_context(found), questions).first()["prompt"]
    elif args.verb == "eval":
        out = evaluation.report(_evaluated(spark, args.cases, args.limit, args.index, args.top_k))
    elif args.verb == "compare":
        out = evaluation.comparison_report(*evaluation.compare(_backends(spark, args)))
        if args.output:
            _write(args.output, out)
    elif args.verb == "prepare-filing":
        page = read_pages(spark, args.input)
        given = [F.lit(x).alias(c) for c, x in (("company", args.company), ("doc_type", args.doc_type), ("filing_date", args.filing_date))]
        rows = Scratch(spark).save(filing.filings(page, strict=True).select("id", *given, "section", "primary_topic", "secondary_topic", "chunk_type", "quality", "title", "text", F.lit(args.input).alias("source")), "chunks")
        jsonl.write_jsonl(rows, args.output)
        counts = filing.section_counts(rows).orderBy("section").collect()
        out = "\n".join([f"chunks: {sum(r.chunks for r in counts)}", *[f"- {r.section}: {r.chunks}" for r in counts]])
    elif args.verb == "prepare-demo":
        lines = sampling.line_numbers(args.input, spark).where(text.strip(F.col("value")) != "")
        fields = F.from_json("value", "id string, title string, text string, source string, time string")
        docs = sampling.sample_articles(sampling.articles(lines.select("line", fields.alias("f")).select("line", "f.*")))
        jsonl.write_jsonl(docs.orderBy("line").select(*chunking.DOCUMENT_FIELDS), args.output)
        out = f"documents: {spark.read.text(args.output).count()}"
    elif args.verb == "prepare-cases":
        lines = sampling.line_numbers(args.input, spark).where(text.strip(F.col("value")) != "")
        said = F.from_json("value", "conversations array<struct<role:string,content:string>>")["conversations"]
        turns = lines.select(F.col("line").alias("conv_id"), F.posexplode(said).alias("turn", "m")).select("conv_id", "turn", "m.role", F.col("m.content").alias("text"))
        cases = sampling.sample_cases(evaluation.usable_pairs(turns), "conv_id").select("qid", "question", "task_type", "reference_answer", F.lit(pathlib.Path(args.input).name).alias("source_dataset"), "conv_id")
        jsonl.write_cases(cases.orderBy("conv_id").drop("conv_id"), args.output)
        out = f"cases: {jsonl.read_cases(spark, args.output).count()}"
    else:
        out = "\n".join(f"{k}: {v}" for k, v in model_from_environment().metadata().items())
    print(out)
    return out


if __name__ == "__main__":
    main()
