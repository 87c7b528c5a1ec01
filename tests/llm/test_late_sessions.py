"""Late session merging against a plain replay of the batches."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm import late_sessions
from skein.llm.late_sessions import CELL, GAP, SessionLog, conversation_events, merge

COLUMNS = ("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s")


def replay(events, gap=GAP):
    """All versions from (user, at, batch, value), the sessions made anew from all events after each batch."""
    out = {}
    standing = {}
    for b in sorted({e[2] for e in events if None not in e[:3]}):
        for user in {e[0] for e in events if e[2] == b and None not in e[:3]}:
            own = sorted(e for e in events if e[0] == user and None not in e[:3] and e[2] <= b)
            sessions = []
            for e in sorted(own, key=lambda e: e[1]):
                if sessions and e[1] - sessions[-1][-1][1] <= gap:
                    sessions[-1].append(e)
                else:
                    sessions.append([e])
            kept = standing.get(user, [])
            for s in sessions:
                new = sum(e[2] == b for e in s)
                if new:
                    old = [k for k in kept if s[0][1] <= k[1] <= s[-1][1]]
                    for k in old:
                        out[user, k[0], k[1]][-2:] = [b, s[0][1]]
                    kept = [k for k in kept if k not in old] + [(b, s[0][1])]
                    out[user, b, s[0][1]] = [user, b, s[0][1], s[-1][1], len(s), new, len(old), sum(e[3] or 0 for e in s), None, None]
            standing[user] = kept
    return sorted((tuple(v) for v in out.values()), key=str)


def run(spark, events, **more):
    df = spark.createDataFrame(events, "user long, at long, batch long, value long")
    return sorted((tuple(r[c] for c in COLUMNS) for r in merge(df, **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, seed):
    """Late events, ties, repeated rows, a user with most of the rows, and chains of events over many cells."""
    rng = random.Random(seed)
    events = []
    for _ in range(500):
        user = rng.choice([1, 1, 1, 2, 3, rng.randrange(40)])
        at = rng.randrange(0, 40_000)
        events.append((user, at, at // 20_000 + rng.choice([0, 0, 1, 2]), rng.randrange(1000)))
    events += [(7, i * 400, rng.randrange(3), i) for i in range(60)]  # one session over six cells at the end
    events += rng.sample(events, 20)
    assert run(spark, events) == replay(events)


def test_cell_edges_and_wide_times(spark):
    """Sessions that meet at edges of cells of every width, a session inside another, times below zero."""
    wide = CELL * late_sessions.FAN
    events = []
    for user, edge in enumerate((CELL, 2 * CELL, wide, wide * 2)):
        events += [(user, edge - 1, 0, 1), (user, edge + 419, 0, 2), (user, edge + 840, 1, 4), (user, edge - 421, 1, 8), (user, -5000, 0, 16)]
    events += [(9, i * 420, 0, 1) for i in range(40)] + [(9, 5000, 1, 1), (9, 40 * 420, 1, 1)]  # an event of batch 1 within a long session
    assert run(spark, events) == replay(events)


def test_nulls_and_empty(spark):
    events = [(None, 1, 0, 1), (1, None, 0, 1), (1, 5, None, 1), (1, 5, 0, None), (1, 5, 0, 7)]
    assert run(spark, events) == [(1, 0, 5, 5, 2, 2, 0, 7, None, None)]
    assert run(spark, []) == []


def test_log_goes_on_and_a_cut_batch_is_done_again(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.randrange(4), at, at // 4000 + rng.choice([0, 0, 1]), 1) for at in (rng.randrange(0, 12_000) for _ in range(80))]
    df = spark.createDataFrame(events, "user long, at long, batch long, value long").withColumn("n", F.lit(1).cast("long"))
    log = SessionLog(spark, str(tmp_path / "log"))
    batches = sorted({e[2] for e in events})
    for b in batches[:2]:
        log.apply(b, df.where(F.col("batch") == b), 0, 12_000, None)
    again = SessionLog(spark, str(tmp_path / "log"))  # another process, on the same folder
    assert again.done == batches[:2]
    import shutil

    shutil.rmtree(tmp_path / "log" / "standing" / str(batches[1]))  # as if it had ended between its two tables
    again = SessionLog(spark, str(tmp_path / "log"))
    assert again.done == batches[:1]
    for b in batches:
        again.apply(b, df.where(F.col("batch") == b), 0, 12_000, None)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in again.versions().collect()), key=str)
    assert got == replay(events)


def test_sealed_sessions_leave_the_standing_table(spark, tmp_path):
    events = [(1, 0, 0, 1), (1, 50_000, 1, 1), (1, 50_100, 2, 1)]
    df = spark.createDataFrame(events, "user long, at long, batch long, value long")
    rows = merge(df, root=str(tmp_path / "log"))
    log = SessionLog(spark, str(tmp_path / "log"))
    assert rows.count() == 3 and [r.start_s for r in log.standing(1).collect()] == [50_000]


def test_events_of_conversations(spark):
    rows = [(c, t) for c in (0, 1, 7, 8, 123456789) for t in (0, 3)] + [(5, None), (None, 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long").withColumn("batch", F.lit("x"))  # a column of a clashing name
    want = []
    for conv, turn in rows:
        if None not in (conv, turn):
            c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
            s = c // 2 % 7200 + 300 * turn + h % 600
            g = h // 600
            want.append((2 * (conv // 8) + c % 2, s, h, s // 3600 + (g % 4 if g % 3 == 0 else 0)))
    assert sorted(tuple(r) for r in conversation_events(df).where("user IS NOT NULL").collect()) == sorted(want)


def test_gap_must_fit_a_cell(spark):
    with pytest.raises(ValueError):
        SessionLog(spark, gap=CELL)
