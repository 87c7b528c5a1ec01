import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import mixing, sharding

SCHEMA = "doc_id long, text string, source string, shard string, slot int"


@pytest.mark.parametrize(("n", "shards"), [(0, 5), (3, 5), (500, 24), (997, 7)])
def test_counts_differ_by_one_and_slots_are_gapless(spark, n, shards):
    rows = [(i, f"text {i}" if i % 7 else None, "s", "x", 1) for i in range(n)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), shards).collect()
    assert len(got) == n
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
        text = rows[r.doc_id][1] or ""
        assert r["size"] == len(text.encode()) + 8
        assert r.text_crc32 == zlib.crc32(text.encode())
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    sizes = [len(per[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_only_overflow_leaves_the_ring(spark):
    rows = [(i, "t", "s", "x", 1) for i in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 8).collect()
    nodes = sharding.ring(8)
    owner = lambda cell: next((s for c, s in nodes if c >= cell), nodes[0][1])
    assert all(r.shard == owner(r.ring_cell) for r in got if not r.moved)
    assert sum(r.moved for r in got) < 500


def test_repeated_rows_and_null_keys(spark):
    rows = [(1, "a", "s", "x", 1)] * 30 + [(None, "b", "s", "x", 1)] * 30 + [(None, None, "s", "x", 1)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), 4, with_text=True).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert sorted(Counter(r.shard for r in got).values()) == [15, 15, 15, 16]
    same = sharding.shard(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), 4).collect()
    key = lambda r: (r.shard, r.slot, r.text_crc32)
    assert sorted(map(key, got)) == sorted(map(key, same))


def test_segments_fill_every_shard():
    counts = {5: 1000, 4095: 3}
    got = sharding.segments(counts, 6)
    assert Counter(s for _, a, b, s, _, _ in got for _ in range(b - a)) == Counter({0: 168, 1: 167, 2: 167, 3: 167, 4: 167, 5: 167})


def water(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_taken(spark):
    rows, n = [], 0
    for source, docs, words in (("a", 40, 10), ("b", 5, 3), (None, 30, 7), ("c", 1, 900), ("é", 20, 4), ("z", 2, 0)):
        for i in range(docs):
            rows.append((n, " ".join(["w"] * (words + i % 3 if words else 0)), source, "x", 1))
            n += 1
    rows.append((n, None, "a", "x", 1))
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len((r[1] or "").split())
    want, taken = water(sizes), defaultdict(int)
    for r in got:
        source = rows[r.doc_id][2]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r["size"]
        assert -(-r.taken // r["size"]) == r.copies if r["size"] else r.copies == 0
        taken[source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    positions = [r.position for r in got if r.position is not None]
    assert positions == sorted(positions)
    assert 0 <= positions[0] and positions[-1] < 1
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copied = mixing.copies(spark.createDataFrame(rows, SCHEMA))
    assert copied.columns == ["doc_id", "text", "source", "shard", "slot"]
    count = Counter(r.doc_id for r in copied.collect())
    assert count == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, "", "a", "", 0), (2, None, None, "", 0)], SCHEMA)).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0), (0, 0.0)]
    assert mixing.copies(spark.createDataFrame([(1, "", "a", "", 0)], SCHEMA)).collect() == []


def test_inverse_of_cumulative_demand(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2], "", 0) for i in range(300)]
    for slope in (0.0, 0.5):
        got = mixing.lay(spark.createDataFrame(rows, SCHEMA), slope=slope).where(F.col("copies") > 0).collect()
        times = {r.doc_id: r.position for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), slope=slope).collect()}
        for r in got:
            t, s = times[r.doc_id], r.slope
            assert r.target * (t + s * (t * t - t)) == pytest.approx(r["at"], abs=1e-6)


def test_every_round_has_its_position(spark):
    rows = [(i, "w " * (i % 5 + 1), "a" if i < 280 else "b", "", 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for slope in (0.0, 0.5):
        laid = mixing.lay(df, slope=slope).collect()
        got = {r.doc_id: r for r in mixing.mix(df, slope=slope).collect()}
        assert max(r.copies for r in laid) == 3
        for r in laid:
            out = got[r.doc_id]
            if not r.copies:
                assert out.positions is None
                continue
            assert len(out.positions) == r.copies and out.positions[0] == out.position
            for j, t in enumerate(out.positions):
                assert r.target * (t + r.slope * (t * t - t)) == pytest.approx(r["at"] + j * r.source_size, abs=1e-6)


def test_copies_follow_the_curriculum(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 4 == 0], "", i) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    due = sorted((t, r.doc_id) for r in mixing.mix(df).collect() for t in r.positions or [])
    got = [r.doc_id for r in mixing.copies(df).collect()]
    times = iter(due)
    assert len(due) > 150 and Counter(got) == Counter(d for _, d in due) and max(Counter(got).values()) > 1
    of = defaultdict(list)
    for t, d in due:
        of[d].append(t)
    seen = Counter()
    for d in got:  # the n-th copy of a document comes at its n-th time
        t, seen[d] = of[d][seen[d]], seen[d] + 1
        assert t == pytest.approx(next(times)[0])


@pytest.mark.parametrize("same", [7, None])
def test_copies_of_rows_with_one_id_or_none(spark, same):
    """The end of the last round falls among rows of one id: only some are taken."""
    rows = [(same, f"w{i}", "a", "", i) for i in range(40)] + [(i, f"w{i}", "b", "", i) for i in range(40, 80)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.slot for r in mixing.copies(df).collect()]
    assert (sum(i < 40 for i in got), sum(i >= 40 for i in got)) == (27, 53)
    assert got == [r.slot for r in mixing.copies(spark.createDataFrame(rows[::-1], SCHEMA)).collect()]
