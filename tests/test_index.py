"""Indexes that are committed whole, streams that are asked as tables are, and calls that fail one by one."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from skein.operators import chunking, embedding, generation, retrieval
from skein.sources import index_store
from skein.streaming import ingest

SCHEMA = "doc_id string, title string, source string, date string, category string, content string"


def documents(spark, ids):
    return spark.createDataFrame([(f"d{i:03}", f"title {i}", "s", "2024", "c", f"subject{i % 7} revenue word{i} " * (20 + i)) for i in ids], SCHEMA)


def chunks(spark, ids):
    return chunking.chunk_records(chunking.chunk_documents(documents(spark, ids)))


def asked(spark, index):
    q = spark.createDataFrame([(1, "subject3 word10 revenue"), (2, "word5 title"), (3, "nothing of it")], "qid long, question string")
    q = q.withColumn("codes", embedding.signed_buckets(F.col("question")))
    return [tuple(r) for r in retrieval.retrieve(q, index, 3).select("qid", "rank", "chunk_id", "position", F.round("score", 6)).orderBy("qid", "rank").collect()]


def test_a_build_that_dies_leaves_the_old_index(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index_store.build(chunks(spark, range(6)), path)
    before, meta = asked(spark, index_store.load(spark, path)), index_store.metadata(spark, path)

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(index_store, "_commit", die)  # rows are written, the manifest isn't
        with pytest.raises(RuntimeError, match="killed"):
            index_store.build(chunks(spark, range(20)), path)
    assert asked(spark, index_store.load(spark, path)) == before and index_store.metadata(spark, path) == meta
    old = index_store.load(spark, path)
    index_store.build(chunks(spark, range(20)), path)
    assert old.count() == int(meta["chunk_count"])  # who reads the old one goes on
    assert index_store.load(spark, path).count() == int(index_store.metadata(spark, path)["chunk_count"]) > old.count()
    assert len(index_store.vacuum(spark, path, keep=1)) == 2 and index_store.load(spark, path).count() == int(index_store.metadata(spark, path)["chunk_count"])


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index_store.build(chunks(spark, range(2)), path)
    monkeypatch.setattr(index_store, "_numbers", lambda *_: [0])  # both saw the same last manifest
    with pytest.raises(RuntimeError, match="another writer"):
        index_store.build(chunks(spark, range(3)), path)


def test_an_older_index_is_read(spark, tmp_path):
    rows = index_store._rows(index_store.with_positions(chunks(spark, range(3))), embedding.HashingModel())
    rows.write.parquet(str(tmp_path / "index" / "rows"))
    (tmp_path / "index" / "meta").mkdir()
    (tmp_path / "index" / "meta" / "part.json").write_text(json.dumps({"meta": {"backend": index_store.BACKEND, "dimension": "256"}}))
    assert index_store.load(spark, str(tmp_path / "index"), 256).count() == rows.count()


def test_stream_then_ask_equals_batch_then_ask(spark, tmp_path):
    """Three batches of a stream, one of which comes again, are the index of one build."""
    path, source = str(tmp_path / "streamed"), tmp_path / "in"
    for n, ids in enumerate((range(0, 4), range(4, 9), range(9, 14))):
        documents(spark, ids).coalesce(1).write.mode("append").parquet(str(source))
        ingest.ingest(spark.readStream.schema(SCHEMA).parquet(str(source)), path, str(tmp_path / "ck")).awaitTermination(120)
        assert index_store.metadata(spark, path)["chunk_count"] == str(chunks(spark, range(ids.stop)).count())
    index_store.build(chunks(spark, range(14)), str(tmp_path / "built"))
    whole, streamed = index_store.load(spark, str(tmp_path / "built")), index_store.load(spark, path, 256)
    columns = sorted(whole.columns)
    assert columns == sorted(streamed.columns)
    assert sorted(map(str, streamed.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    want = asked(spark, whole)
    assert asked(spark, streamed) == want
    again = index_store.append(chunks(spark, range(4, 9)), path, str(tmp_path / "ck"), 1)  # as after a failure behind the commit
    assert again is False and asked(spark, index_store.load(spark, path)) == want
    index_store.compact(spark, path)
    assert asked(spark, index_store.load(spark, path)) == want and len(index_store._manifest(spark, path)["snapshots"]) == 1
    with pytest.raises(ValueError, match="more than once"):
        index_store.append(chunks(spark, [3]), path, "another", 0)
    with pytest.raises(ValueError, match="another model"):
        index_store.append(chunks(spark, [30]), path, "another", 0, embedding.HashingModel(16))
    assert asked(spark, index_store.load(spark, path)) == want


def test_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index_store.append(chunks(spark, []), path, "s", 0)
    with pytest.raises(ValueError, match="no rows"):
        index_store.load(spark, path)
    assert index_store.append(chunks(spark, [1]), path, "s", 1) and index_store.load(spark, path).count() == 2 - 1


def test_only_failed_calls_fall_back(spark, tmp_path):
    """The second call of each task fails: its rows alone are hashed, each text is sent once, and nothing comes to the driver."""
    log = str(tmp_path / "calls")

    def call(texts):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        if "t3" in texts:
            raise embedding.EmbeddingError("EmbeddingError: down")
        return [[1.0] * 8 for _ in texts]

    df = spark.createDataFrame([(i, f"t{i}") for i in range(8)], "i int, t string").coalesce(1)
    model = embedding.FallbackModel(embedding.BatchModel(call, 8, "remote", batch_size=2), embedding.HashingModel(8))
    rows = model.vectors(df, "t")
    got = {r.i: (r.embedding_provider, r.vector == [1.0] * 8) for r in rows.collect()}
    assert got == {i: ("hashing", False) if i in (2, 3) else ("remote", True) for i in range(8)}
    rows.count()
    assert sorted(pathlib.Path(log).read_text().split()) == sorted(f"t{i}" for i in range(8))
    with pytest.raises(Exception, match="down"):
        model.first.vectors(df, "t").collect()
    few = embedding.FallbackModel(embedding.BatchModel(lambda xs: [[1.0]] * len(xs), 8), embedding.HashingModel(8))
    assert {r.embedding_provider for r in few.vectors(df, "t").collect()} == {"hashing"}  # vectors of another length are a failure
    assert few.vectors(df.limit(0), "t").count() == 0


def test_only_failed_questions_fall_back(spark):
    def call(prompts):
        if any("second question" in p for p in prompts):
            raise generation.LLMGenerationError("LLMGenerationError: down")
        return ["Answer: from afar\nSources:\n- x\nEvidence:\n- y" for _ in prompts]

    q = spark.createDataFrame([(1, "first question about revenue"), (2, "second question about revenue"), (3, "third without context")], "qid long, question string")
    context = chunks(spark, [1]).limit(1).crossJoin(spark.createDataFrame([(1,), (2,)], "qid long")).withColumn("context_rank", F.lit(1)).withColumn("score", F.lit(1.0))
    rows = {r.qid: r.raw for r in generation.Fallback(generation.Remote(call), generation.Extractive()).raw(q, context).collect()}
    assert set(rows) == {1, 2} and "from afar" in rows[1] and "from afar" not in rows[2]


@pytest.mark.parametrize(("said", "want"), [("1", True), ("TRUE", True), (" yes ", True), ("on", True), ("", True), ("0", False), ("False", False), (" off ", False), ("no", False)])
def test_settings_of_truth(said, want):
    assert embedding.truth(said) is want
