"""Strict JSON lines: every line is a document or a reject with a reason.

Lines end at newline or carriage return only; blank ones are skipped. Rejects, and the
error of a strict read, name the file and the physical number of their line. Documents need
strings in all fields. Chunks come in a generic or a filing form, told apart on each
line (an ``id`` without ``chunk_id`` is the filing form); other scalars are taken as
text there, nulls and missing fields are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import strip
from skein.operators.chunking import CHUNK_DEFAULTS, DOCUMENT_FIELDS, chunk_records, filing_records
from skein.sources.lines import numbered_lines

GENERIC_REQUIRED = ("chunk_id", "doc_id", "title", "source", "date", "chunk_index", "text")
FILING_REQUIRED = ("id", "company", "doc_type", "filing_date", "section", "primary_topic", "secondary_topic", "chunk_type", "quality", "title", "text", "source")


def _lines(spark: SparkSession, path: str, numbered: bool) -> DataFrame:
    rows = numbered_lines(spark, path) if numbered else spark.read.text(path)
    return rows.where(strip(F.col("value")) != "").withColumn("j", F.try_parse_json("value"))


def _kind(field: str) -> Column:
    """JSON type of a field of ``j``; null if it is missing."""
    return F.schema_of_variant(F.try_variant_get("j", f"$.{field}", "variant"))


def _text(field: str) -> Column:
    return F.try_variant_get("j", f"$.{field}", "string")


def read_documents(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects with reason, line, file and number); strict: a reject is an error when the documents are read."""
    reason = F.lit(None).cast("string")
    for f in reversed(DOCUMENT_FIELDS):
        reason = F.when(_kind(f).isNull(), f"missing {f}").when(_kind(f) != "STRING", f"{f} is no string").when(strip(_text(f)) == "", f"empty {f}").otherwise(reason)
    reason = F.when(F.col("j").isNull(), "malformed").when(~F.startswith(F.schema_of_variant("j"), F.lit("OBJECT")), "no object").otherwise(reason)
    good = _lines(spark, path, strict).withColumn("reason", reason).where(_checked(strict)).select(*[strip(_text(f)).alias(f) for f in DOCUMENT_FIELDS])
    return good, _rejects(_lines(spark, path, True).withColumn("reason", reason))


def _rejects(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("reason", F.col("value").alias("line"), "file", "number")


def _checked(strict: bool) -> Column:
    good = F.col("reason").isNull()
    where = F.concat(F.col("file"), F.lit(", line "), F.col("number").cast("string"), F.lit(": "), F.col("reason"), F.lit(": "), F.col("value")) if strict else None
    return F.when(good, True).otherwise(F.raise_error(where).cast("boolean")) if strict else good


def read_chunks(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunk records of both forms, rejects as of documents)."""

    def missing(fields: tuple[str, ...]) -> Column:
        out = F.lit(None).cast("string")
        for f in reversed(fields):
            out = F.when(_kind(f).isNull() | (_kind(f) == "VOID"), f"missing {f}").otherwise(out)
        return F.coalesce(out, F.when(strip(F.coalesce(_text("text"), F.lit(""))) == "", "empty text"))

    number = F.when(~F.coalesce(_kind("chunk_index").isin("BIGINT", "BOOLEAN"), F.lit(False)), "chunk_index is no integer").when(_kind("text") != "STRING", "text is no string")
    reason = F.when(F.col("j").isNull(), "malformed").when(F.col("filing"), missing(FILING_REQUIRED)).otherwise(F.coalesce(missing(GENERIC_REQUIRED), number))

    def judged(numbered: bool) -> DataFrame:
        return _lines(spark, path, numbered).withColumn("filing", _kind("id").isNotNull() & _kind("chunk_id").isNull()).withColumn("reason", reason)

    good = judged(strict).where(_checked(strict))
    generic = good.where("not filing").select(*[_text(f).alias(f) for f in (*GENERIC_REQUIRED, *CHUNK_DEFAULTS)])
    generic = generic.withColumn("chunk_index", F.when(F.col("chunk_index") == "true", "1").when(F.col("chunk_index") == "false", "0").otherwise(F.col("chunk_index")))
    filing = good.where("filing").select(*[_text(f).alias(f) for f in FILING_REQUIRED])
    return chunk_records(generic).unionByName(filing_records(filing)), _rejects(judged(True))


def write_jsonl(rows: DataFrame, path: str) -> None:
    """UTF-8 JSON lines, nothing escaped that need not be, nulls written."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of cases, with their position."""
    from skein.operators.evaluation import cases

    schema = "array<struct<qid:string,question:string,task_type:string,reference_answer:string,source_dataset:string>>"
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", schema)).alias("position", "c")).select("position", "c.*")
    needed = F.when(F.col("qid").isNull() | F.col("question").isNull(), F.raise_error(F.lit("a case needs qid and question")).cast("string")).otherwise(F.col("qid"))
    return cases(rows.withColumn("qid", needed))


def write_cases(rows: DataFrame, path: str) -> None:
    """A bounded table of cases as one indented JSON array on the driver's disk."""
    import json
    import pathlib

    got = [r.asDict() for r in rows.collect()]
    pathlib.Path(path).parent.mkdir(parents=True, exist_ok=True)
    pathlib.Path(path).write_text(json.dumps(got, ensure_ascii=False, indent=2), encoding="utf-8")
