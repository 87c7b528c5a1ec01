"""Physical line numbers of files that are read in ranges."""

import random

import pytest
from skein.operators import sampling
from skein.sources import jsonl
from skein.sources.lines import numbered_lines


@pytest.fixture
def small_ranges(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_ranges_and_files(spark, tmp_path, small_ranges):
    rng, want, line = random.Random(1), [], 0
    for name in ("a.txt", "b.txt", "c.txt", "d.txt", "e.txt"):
        n = {"b.txt": 0, "d.txt": 1}.get(name, 700)
        ends = [rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(n)]
        texts = ["x" * rng.choice([0, 0, 3, 50, 2500 if i % 100 == 0 else 10]) + str(i) * (i % 3 > 0) for i in range(n)]
        whole = "".join(t + e for t, e in zip(texts, ends, strict=True))
        (tmp_path / name).write_text(whole, newline="")
        got = whole.replace("\r\n", "\n").split("\n")[:-1] if whole else []
        want += [(name, i, line + i, t) for i, t in enumerate(got, 1)]
        line += len(got)
    rows = numbered_lines(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 20
    assert sorted((r.file.rsplit("/", 1)[1], r.number, r.line, r.value) for r in rows.collect()) == want
    both = rows.where("number < 3").unionByName(rows.where("number >= 3"))  # in a plan where the tasks have other numbers
    assert sorted((r.file.rsplit("/", 1)[1], r.number, r.line, r.value) for r in both.collect()) == want
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_rejects_and_errors_name_the_line(spark, tmp_path, small_ranges):
    good = '{"doc_id":"%d","title":"t","source":"s","date":"d","category":"c","content":"x"}'
    lines = [good % i for i in range(200)]
    lines[3], lines[150] = "", "{broken"
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    docs, rejects = jsonl.read_documents(spark, str(tmp_path / "d.jsonl"))
    assert docs.count() == 198
    assert [(r.reason, r.number, r.file.rsplit("/", 1)[1]) for r in rejects.collect()] == [("malformed", 151, "d.jsonl")]
    with pytest.raises(Exception, match=r"d\.jsonl, line 151: malformed"):
        jsonl.read_documents(spark, str(tmp_path / "d.jsonl"), strict=True)[0].collect()
    (tmp_path / "c.jsonl").write_text('\n\n{"chunk_id":"c"}')
    with pytest.raises(Exception, match=r"c\.jsonl, line 3: missing doc_id"):
        jsonl.read_chunks(spark, str(tmp_path / "c.jsonl"), strict=True)[0].collect()


def test_article_lines(spark, tmp_path, small_ranges):
    (tmp_path / "a.jsonl").write_text("\n\n" + "\n".join("line %d" % i for i in range(500)))
    got = sampling.line_numbers(str(tmp_path / "a.jsonl"), spark).where("value <> ''").orderBy("line").collect()
    assert [r.line for r in got] == list(range(3, 503)) and got[0].value == "line 0"
