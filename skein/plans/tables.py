"""The driver's tables as the engine's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.rules import SECTIONS
from skein.functions.text import plain_or_tokens, strip, word_tokens
from skein.operators.chunking import chunk_documents, embedding_text
from skein.storage import read_table

TOPICS = ("regulatory_risk", "financial_risk", "business_segment", "company_overview", "competition", "performance_analysis", "operational_risk", "business_structure")
DATE = "2024-01-01"


#: The column by which the rows of a small table are dealt to the cores.
KEYS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id", "conversations": "conv_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", KEYS.get(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (the first line, 80 characters), source, date, category, content."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", strip(F.substring(F.split("text", "\n")[0], 1, 80)).alias("title"), "source", F.lit(DATE).alias("date"), F.col("lang").alias("category"), F.col("text").alias("content"))


#: Bytes of a table's files that one task of the search gets.
DEALT = 8 << 20


def dealt(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` in tasks whose number follows the input: a file may be one row group, which one task would work through alone."""
    size = int(str(spark.read.parquet(f"{sf_dir}/documents.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(max(2 * spark.sparkContext.defaultParallelism, size // DEALT), "doc_id")


#: Positions of the chunks of one document.
PLACES = 1048576


def chunks(spark: SparkSession, sf_dir: str, found: DataFrame | None = None, deal: bool = False) -> DataFrame:
    """Chunks of all documents with labels for reranking; position orders them by document and index.

    ``found``: only the documents of these positions are cut. ``deal``: in tasks of ``DEALT`` bytes, for costly work on the chunks.
    """
    docs = documents(spark, sf_dir)
    if deal:
        docs = dealt(docs, spark, sf_dir)
    if found is not None:
        docs = docs.join(found.select(F.floor(F.col("position") / PLACES).alias("doc_id")).distinct(), "doc_id", "left_semi")
    kept = chunk_documents(docs)
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    sections, topics = F.array(*[F.lit(s) for s in SECTIONS]), F.array(*[F.lit(t) for t in TOPICS])
    return kept.join(labels, "doc_id", "left").select(
        (F.col("doc_id") * PLACES + F.col("chunk_index")).alias("position"), "chunk_id", "doc_id", "title", "source", "date", "chunk_index", "text",
        F.get(sections, (F.col("doc_id") % 3).cast("int")).alias("section"), F.get(topics, (F.col("doc_id") % 8).cast("int")).alias("primary_topic"), F.lit("").alias("secondary_topic"),
        F.lit("text").alias("chunk_type"), F.when(F.col("q") == 1, "high").when(F.col("q") == 0, "medium").otherwise("low").alias("quality"),
    )


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with what is embedded, or its tokens; the search hashes them."""
    return chunks(spark, sf_dir, deal=True).withColumn("codes", plain_or_tokens(embedding_text()))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), word_tokens(F.col("text")).alias("codes"))
