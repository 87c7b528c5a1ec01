"""HTML files as rows, read as bytes and decoded with the bad ones left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Two noncharacters, which no text for interchange holds, that stand for U+FFFD while bad bytes become it.
_KEPT = "﷐﷑"


def decoded(content: Column) -> Column:
    """Bytes as text, UTF-8; bytes that aren't are left out, and a replacement character that was written stays."""
    said = F.replace(content.cast("string"), F.lit("�"), F.lit(_KEPT))
    return F.replace(F.replace(F.make_valid_utf8(said), F.lit("�"), F.lit("")), F.lit(_KEPT), F.lit("�"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc, html) of every file of a path that isn't empty; doc is its name without the ending. Line ends are those of the file."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(F.url_decode(name).alias("doc"), decoded(F.col("content")).alias("html"))
