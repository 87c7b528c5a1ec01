"""Streaming ingest: documents are chunked and hashed as they arrive, and appended to an index once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.chunking import ChunkingConfig, chunk_documents, chunk_records, embedding_text
from skein.operators.embedding import DIMENSION, EmbeddingModel, signed_buckets
from skein.sources import index_store


def prepared(docs: DataFrame, config: ChunkingConfig = ChunkingConfig(), dimension: int = DIMENSION) -> DataFrame:
    """Chunk records with signed buckets; stateless, so the same for a stream and a table."""
    return chunk_records(chunk_documents(docs, config)).withColumn("codes", signed_buckets(embedding_text(), dimension))


def ingest(docs: DataFrame, path: str, checkpoint: str, config: ChunkingConfig = ChunkingConfig(), available_now: bool = True, model: EmbeddingModel | None = None) -> StreamingQuery:
    """Append a stream of documents to the index at ``path``, batch by batch, each of them once: a batch that comes again after a failure is known by its number.

    The index can be asked between batches, as one that was built at once.
    """

    def write(batch: DataFrame, number: int) -> None:
        index_store.append(batch, path, checkpoint.rstrip("/"), number, model)

    out = chunk_records(chunk_documents(docs, config)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def volume(docs: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Documents and characters in each window of event time."""
    return docs.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("documents"), F.sum(F.length("content")).alias("characters"))
