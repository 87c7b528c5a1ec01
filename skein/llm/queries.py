"""The queries of this subpackage, by name; each takes (spark, folder of the tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import ann, context_mixing, decontaminate, language_id, late_sessions, lexical_search, mixing, ngram_join, pii, samples, secret_scan, sharding, suffix_dedup, toxicity
from skein.llm.oracles import ORACLES  # noqa: F401
from skein.storage import read_table

SHARDS = 24


#: The column by which the rows of a small table are dealt to the cores.
KEYS = {"documents": "doc_id", "embeddings": "vec_id"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", KEYS.get(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(_read(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents"))


def op3_shard_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "ring_cell", "moved")


def op4_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_pii_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.train(docs)))


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_read(spark, sf_dir, "documents")))


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    out = toxicity.tag(docs, model)
    return out.select("doc_id", (samples.fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_toxic_words", "spans")


def op9_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.identify(docs.select("doc_id", "text"), language_id.train(docs))
    return out.select("doc_id", (samples.fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op10_mix_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("positions")  # the operator's; the digest has the first of them


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return context_mixing.score(docs, context_mixing.train(docs))


def op13_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_sessions.merge(late_sessions.conversation_events(_read(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_ngram_join, op3_shard_ring, op4_ann_tree, op5_decontaminate, op6_pii_lstm, op7_secret_ledger, op8_toxicity_crf, op9_language_kernel, op10_mix_curriculum, op11_lexical_search, op12_context_mixing, op13_late_sessions)}
