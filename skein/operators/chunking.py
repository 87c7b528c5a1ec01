"""Documents and their validation; fixed overlapping windows; the text that is embedded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import let, strip

DOCUMENT_FIELDS = ("doc_id", "title", "source", "date", "category", "content")
CHUNK_DEFAULTS = {"company": "", "doc_type": "", "section": "", "primary_topic": "", "secondary_topic": "", "chunk_type": "text", "quality": "medium"}
CHUNK_FIELDS = ("chunk_id", "doc_id", "title", "source", "date", "chunk_index", "text", *CHUNK_DEFAULTS)
EMBEDDED_FIELDS = ("title", "section", "primary_topic", "secondary_topic", "chunk_type", "quality", "text")


@dataclass(frozen=True)
class ChunkingConfig:
    size: int = 500
    overlap: int = 80

    def __post_init__(self):
        if self.size <= 0:
            raise ValueError("the size of a chunk must be positive")
        if not 0 <= self.overlap < self.size:
            raise ValueError("the overlap must be 0 or more and less than the size")


def reject_reason(fields: tuple[str, ...] = DOCUMENT_FIELDS) -> Column:
    """Why a document (columns of strings) is rejected: the first field that is missing or blank; null if none is."""
    out = F.lit(None).cast("string")
    for f in reversed(fields):
        out = F.when(F.col(f).isNull(), F.lit(f"missing {f}")).when(strip(F.col(f)) == "", F.lit(f"empty {f}")).otherwise(out)
    return out


def validated(docs: DataFrame) -> DataFrame:
    """The valid documents, stripped."""
    return docs.where(reject_reason().isNull()).select(*[strip(F.col(f)).alias(f) for f in DOCUMENT_FIELDS])


def windows(text: Column, config: ChunkingConfig = ChunkingConfig()) -> Column:
    """Array of overlapping windows of the stripped text, each stripped, without blank ones.

    The text is cut once into pieces of one step; a window is the head of the few pieces from its start on. Cutting each
    window out of the whole text would count its characters from the beginning every time.
    """
    step = config.size - config.overlap
    span = -(-config.size // step)

    def cut(body: Column, pieces: Column) -> Column:
        count = F.when(F.length(body) <= config.size, 1).otherwise(F.ceil((F.length(body) - config.size) / step) + 1).cast("int")
        window = lambda i: strip(F.substring(F.array_join(F.slice(pieces, i, span), ""), F.lit(1), F.lit(config.size)))
        return F.filter(F.transform(F.sequence(F.lit(1), count), window), lambda s: s != "")

    cuts = lambda body: let(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), lambda pieces: cut(body, pieces))
    return let(strip(text), lambda body: F.when(body != "", cuts(body)).otherwise(F.expr("cast(array() as array<string>)")))


def chunk_documents(docs: DataFrame, config: ChunkingConfig = ChunkingConfig(), text: str = "content") -> DataFrame:
    """One row for each chunk: the document's columns but its text, chunk_index (dense), text and chunk_id."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(windows(F.col(text), config)).alias("chunk_index", "text")).withColumn(
        "chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))
    )


def chunk_records(df: DataFrame) -> DataFrame:
    """Generic chunk rows with all fields: missing ones by default, blank kind and quality replaced."""
    have = set(df.columns)
    cols = []
    for f in CHUNK_FIELDS:
        if f == "chunk_index":
            cols.append(F.col(f).cast("int").alias(f))
            continue
        x = strip(F.coalesce(F.col(f).cast("string"), F.lit(""))) if f in have else F.lit("")
        default = CHUNK_DEFAULTS.get(f, "")
        cols.append((F.when(x == "", default).otherwise(x) if default else x).alias(f))
    return df.select(*cols)


def chunk_number(chunk: Column) -> Column:
    """The digits after the last underscore of an id, else 0."""
    last = F.substring_index(chunk, "_", -1)
    return F.when(last.rlike("^[0-9]+$"), last.cast("int")).otherwise(0)


def filing_records(df: DataFrame) -> DataFrame:
    """Filing chunks (id, company, filing_date, ...) as chunk records."""
    s = lambda c: strip(F.col(c).cast("string"))
    return df.select(
        s("id").alias("chunk_id"), strip(F.concat_ws(" ", s("company"), s("doc_type"))).alias("doc_id"), s("title").alias("title"), s("source").alias("source"),
        s("filing_date").alias("date"), chunk_number(s("id")).alias("chunk_index"), s("text").alias("text"),
        *[s(c).alias(c) for c in CHUNK_DEFAULTS],
    )


def embedding_text() -> Column:
    """Newline-joined fields of a chunk that aren't empty."""
    return F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in EMBEDDED_FIELDS])
