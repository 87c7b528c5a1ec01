"""The index: chunks and vectors by position in Parquet snapshots, and a manifest that names those that count.

A build writes a snapshot folder of its own and then a manifest: one small file, made beside
its place and renamed into it, numbered one higher than the last. Readers take the highest
number, so they see the index of before or of after, never rows of one and metadata of
another; a build that dies leaves the old index as it was. Two writers can't take the same number: the second fails. Snapshots that the
last manifests no longer name are deleted by ``vacuum`` alone, so those who read go on reading.

``append`` adds a batch of a stream to the last manifest: its chunks get the positions
after the highest so far, and the manifest remembers the batch's number, so that a
batch that comes again is left out. ``compact`` writes many small snapshots as one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.chunking import CHUNK_DEFAULTS, CHUNK_FIELDS, embedding_text
from skein.operators.embedding import DIMENSION, EmbeddingModel, HashingModel, signed_buckets

BACKEND = "parquet_flat"


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests, ascending."""
    folder, fs = _place(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def _manifest(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """A manifest (the last one, if no number is given): meta, snapshots, next_position and the last batch of each stream; None without any."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    number = numbers[-1] if number is None else number
    return {"number": number, **json.loads(spark.read.text(f"{path}/manifests/{number}.json", wholetext=True).first()["value"])}


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Puts a manifest in its place, whole or not at all."""
    made, fs = _place(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    place, _ = _place(spark, f"{path}/manifests/{number}.json")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "number"}).encode()))
    out.close()
    if fs.exists(place) or not fs.rename(made, place):
        fs.delete(made, False)
        raise RuntimeError(f"another writer has committed manifest {number} of {path}")


def with_positions(chunks: DataFrame) -> DataFrame:
    """A position for each chunk in the order of doc_id and chunk_index: ranks within range partitions plus the rows before."""
    spread = chunks.repartitionByRange("doc_id", "chunk_index", "chunk_id").withColumn("__p", F.spark_partition_id())
    counts = spread.groupBy("__p").count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy("doc_id", "chunk_index", "chunk_id")) - 1
    return spread.withColumn("__r", inside).join(F.broadcast(before.select("__p", "__before")), "__p").withColumn("position", F.col("__before") + F.col("__r")).drop("__p", "__r", "__before")


def _rows(chunks: DataFrame, model: EmbeddingModel) -> DataFrame:
    """Chunk records with position, codes or vector, and what made them."""
    rows = chunks.select("position", *CHUNK_FIELDS).withColumn("__text", embedding_text())
    if isinstance(model, HashingModel):
        return rows.withColumn("codes", signed_buckets(F.col("__text"), model.dimension)).drop("__text").withColumn("embedding_provider", F.lit("hashing"))
    return model.vectors(rows, "__text").drop("__text")


def _once(chunks: DataFrame) -> None:
    twice = chunks.groupBy("chunk_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"chunk_id {twice[0].chunk_id} occurs more than once")


def _snapshot(rows: DataFrame, path: str) -> tuple[str, int, int]:
    """(name, rows, next position) of a new snapshot."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{path}/snapshots/{name}")
    n, last = spark.read.parquet(f"{path}/snapshots/{name}").agg(F.count(F.lit(1)), F.max("position")).first()
    return name, n, (-1 if last is None else last) + 1


def build(chunks: DataFrame, path: str, model: EmbeddingModel | None = None) -> dict[str, str]:
    """Write the index of chunk records and give its metadata. Equal chunk ids are an error, and leave an older index as it was."""
    spark, model = chunks.sparkSession, model or HashingModel(DIMENSION)
    _once(chunks)
    number = (_numbers(spark, path) or [0])[-1] + 1
    name, n, after = _snapshot(_rows(chunks if "position" in chunks.columns else with_positions(chunks), model), path)
    meta = {"backend": BACKEND, "chunk_count": str(n), **model.metadata()}
    _commit(spark, path, number, {"meta": meta, "snapshots": [name], "next_position": after, "batches": {}})
    return meta


def append(chunks: DataFrame, path: str, stream: str, batch: int, model: EmbeddingModel | None = None) -> bool:
    """Add a batch of a stream to an index, a new one if there is none. False if the batch (or a later one) is in it already.

    A chunk id that the index or the batch holds twice is an error.
    """
    spark, model = chunks.sparkSession, model or HashingModel(DIMENSION)
    old = _manifest(spark, path) or {"number": 0, "meta": {"backend": BACKEND, "chunk_count": "0", **model.metadata()}, "snapshots": [], "next_position": 0, "batches": {}}
    if old["batches"].get(stream, -1) >= batch:
        return False
    if old["meta"].get("provider") != model.metadata().get("provider") or old["meta"].get("dimension") != model.metadata().get("dimension"):
        raise ValueError("the index was made by another model")
    placed = with_positions(chunks.drop("position")).withColumn("position", F.col("position") + old["next_position"])
    name, n, after = _snapshot(_rows(placed, model), path)
    new = spark.read.parquet(f"{path}/snapshots/{name}").select("chunk_id")
    _once(new)
    known = _read(spark, path, old["snapshots"])
    if known is not None and (again := new.join(known.select("chunk_id"), "chunk_id", "left_semi").first()):
        raise ValueError(f"chunk_id {again.chunk_id} occurs more than once")
    meta = {**old["meta"], "chunk_count": str(int(old["meta"]["chunk_count"]) + n)}
    manifest = {"meta": meta, "snapshots": [*old["snapshots"], *([name] if n else [])], "next_position": max(after, old["next_position"]), "batches": {**old["batches"], stream: batch}}
    _commit(spark, path, old["number"] + 1, manifest)
    return True


def _read(spark: SparkSession, path: str, snapshots: list[str]) -> DataFrame | None:
    return spark.read.option("mergeSchema", "true").parquet(*[f"{path}/snapshots/{n}" for n in snapshots]) if snapshots else None


def compact(spark: SparkSession, path: str) -> None:
    """One snapshot of all rows, in the order of their positions; positions stay."""
    old = _manifest(spark, path)
    if old and len(old["snapshots"]) > 1:
        name, _, _ = _snapshot(_read(spark, path, old["snapshots"]).repartitionByRange("position").sortWithinPartitions("position"), path)
        _commit(spark, path, old["number"] + 1, {**old, "snapshots": [name]})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the snapshots that none of the last ``keep`` manifests name, and the manifests before these. Not while someone writes."""
    numbers = _numbers(spark, path)
    named = {n for number in numbers[-keep:] for n in _manifest(spark, path, number)["snapshots"]}
    folder, fs = _place(spark, f"{path}/snapshots")
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in named] if fs.exists(folder) else []
    for p in [*gone, *[_place(spark, f"{path}/manifests/{n}.json")[0] for n in numbers[:-keep]]]:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)


def metadata(spark: SparkSession, path: str) -> dict[str, str]:
    manifest = _manifest(spark, path)
    return manifest["meta"] if manifest else spark.read.schema("meta map<string,string>").json(f"{path}/meta").first()["meta"]


def load(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """The rows of an index; another dimension than that of the questions' model is an error, older tables get defaults."""
    manifest = _manifest(spark, path)
    meta = manifest["meta"] if manifest else metadata(spark, path)  # an index from before there were manifests
    if meta.get("backend") != BACKEND:
        raise ValueError(f"Unsupported backend: {meta.get('backend')}")
    stored = meta.get("dimension", "")
    if dimension is not None and stored.isdigit() and int(stored) != dimension:
        raise ValueError(f"the index has dimension {stored}, the questions {dimension}")
    rows = _read(spark, path, manifest["snapshots"]) if manifest else spark.read.parquet(f"{path}/rows")
    if rows is None:
        raise ValueError(f"the index {path} has no rows yet")
    for name, default in CHUNK_DEFAULTS.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(default))
    return rows
