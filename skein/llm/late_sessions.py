"""Sessions of late events, merged batch by batch by a driver loop over persisted tables.

Events (user, at, batch, and a number ``value``) arrive in batches; some come batches
late. After each batch a user's events so far form sessions: neighbours in time at
most ``gap`` apart share one. Each session that holds an event of the batch is a new
version, which retracts the earlier standing sessions it contains.

One batch is worked through by ``SessionLog.apply``:

1. its events become micro-sessions,
2. standing sessions of affected users, near a micro-session, are united with them,
3. these are made into islands again; those with new events are appended as versions,
4. the standing table is written anew, each retracted session with what retracted it.

Both tables are Parquet in the shared folder, so lineage is cut after every batch, a
lost executor costs its own tasks only, and a log opened again on its folder goes on
after the last finished batch. A batch that was cut short is done again from the start.

No user goes through one task. Events are first added up by user and second. Islands
are found in cells of ``CELL`` seconds of one user; only sessions at a cell's edge
can go on in the next cell, two a cell at most, so these alone meet again in cells
``FAN`` times as wide, until one cell spans all. A session that covers several cells
stands in each with a piece, and the pieces join again by the same rule. Standing
sessions that no later event can reach (the lowest time of the batches to come is
known from one row a batch) leave the standing table; they stay in the log.

Joins are by user and cell, never by broadcast. What goes to the driver is a row for
each batch: its number, first and last time.

Rows without user, time or batch are in no session. Repeated rows are events of
their own. Ties in time share a session. A batch without events makes no version. An
empty table gives an empty result. Other columns, of any name, aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.storage import Scratch

GAP = 420
CELL = 4096
FAN = 32
VERSION = ("user", "batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum")
_SCHEMA = ", ".join(f"{c} long" for c in VERSION)


def _cell(at: str, origin: int, width: int = CELL) -> str:
    return f"CAST(floor(({at} - {origin}L) / {width}) AS LONG)"


def _cells(start: str, end: str, origin: int) -> str:
    return f"explode(sequence({_cell(start, origin)}, {_cell(end, origin)})) AS cell"


def pieces(rows: DataFrame, origin: int, sums: tuple[str, ...]) -> DataFrame:
    """Each session cut at the edges of cells; its sums stay with the first piece."""
    low, own = f"cell * {CELL} + {origin}L", f"cell = {_cell('start_s', origin)}"
    cut = rows.selectExpr("*", _cells("start_s", "end_s", origin))
    return cut.selectExpr("user", f"greatest(start_s, {low}) AS start_s", f"least(end_s, {low} + {CELL - 1}) AS end_s", *[f"if({own}, {c}, 0L) AS {c}" for c in sums])


def islands(rows: DataFrame, gap: int, origin: int, sums: tuple[str, ...], last: int | None = None) -> DataFrame:
    """(user, start_s, end_s, sums) of the sessions of rows (start_s, end_s) that lie within a cell each, all of them at ``origin`` or later.

    With ``last``, their latest time, sessions of neighbouring cells join; without, they end with their cell.
    """
    width, lone = CELL, "CAST(NULL AS LONG)"
    while True:
        order = "PARTITION BY user, cell, lone ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND"
        rows = rows.selectExpr("user", f"{_cell('start_s', origin, width)} AS cell", f"{lone} AS lone", "start_s", "end_s", *sums)
        rows = rows.selectExpr("*", f"if(start_s <= {gap} + max(end_s) OVER ({order} 1 PRECEDING), 0, 1) AS new").selectExpr("*", f"sum(new) OVER ({order} CURRENT ROW) AS part")
        rows = rows.groupBy("user", "cell", "lone", "part").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), *[F.sum(c).alias(c) for c in sums])
        if last is None or last - origin < width:
            return rows.select("user", "start_s", "end_s", *sums)
        # Only what lies within the gap of its cell's edge can go on; all else is done and stands alone from here on.
        low = f"cell * {width} + {origin}L"
        lone = f"if(lone IS NULL AND (start_s < {low} + {gap} OR end_s >= {low} + {width - gap}), NULL, start_s)"
        width *= FAN


class SessionLog:
    """Versions of sessions in the folder ``root``; a new log where that is None."""

    def __init__(self, spark: SparkSession, root: str | None = None, gap: int = GAP):
        if not 0 < gap < CELL:
            raise ValueError(f"gap must be positive and below {CELL}")
        self.spark, self.gap, self.scratch = spark, gap, Scratch(spark)
        if root:
            self.scratch.root = root.rstrip("/")
        self.done = self._finished()

    def _finished(self) -> list[int]:
        """Numbers of the batches whose standing table is complete, ascending."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.scratch.root}/standing")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        folders = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()) for p in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, kind: str, batches: list[int], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.scratch.root}/{kind}/{b}" for b in batches])

    def standing(self, after: int | None = None) -> DataFrame:
        """The sessions that stand after a batch (None: the last one) and that a later event can reach."""
        got = [b for b in self.done if after is None or b <= after][-1:]
        kept = self._read("standing", got, f"{_SCHEMA}, retracted_batch long, retracted_start_s long, sealed boolean").where("retracted_batch IS NULL AND NOT sealed")
        return kept.select(*VERSION).unionByName(self._read("versions", got, _SCHEMA))

    def apply(self, batch: int, events: DataFrame, origin: int, last: int, low: int | None) -> None:
        """Merges the events (user, at, n, value) of one batch.

        All times so far are ``origin`` or later, ``last`` or earlier; no event of a later batch is before ``low`` (None: unknown, so every session stays).
        """
        if self.done and batch <= self.done[-1]:
            return
        gap, was = self.gap, self.standing()
        new = events.selectExpr("user", "at AS start_s", "at AS end_s", "n AS n_new", "value AS h_sum")
        micro = islands(new, gap, origin, ("n_new", "h_sum"))
        near = micro.selectExpr("user", _cells(f"start_s - {gap}", f"end_s + {gap}", origin))
        touched = was.selectExpr("user", "start_s", _cells("start_s", "end_s", origin)).join(near.hint("merge"), ["user", "cell"], "left_semi")
        affected = was.join(touched.hint("merge"), ["user", "start_s"], "left_semi")
        sums = ("n_events", "n_new", "n_retracted", "h_sum")
        both = pieces(affected.selectExpr("user", "start_s", "end_s", "n_events", "0L AS n_new", "1L AS n_retracted", "h_sum"), origin, sums).unionByName(
            micro.selectExpr("user", "start_s", "end_s", "n_new AS n_events", "n_new", "0L AS n_retracted", "h_sum")
        )
        made = islands(both, gap, origin, sums, last).where("n_new > 0").withColumn("batch", F.lit(batch).cast("long"))
        made = self.scratch.save(made.select(*[F.col(c).cast("long").alias(c) for c in VERSION]), f"versions/{batch}")
        over = made.selectExpr("user AS u", "start_s AS s", "end_s AS e", _cells("start_s", "end_s", origin))
        inside = F.expr(f"user = u AND cell = {_cell('start_s', origin)} AND start_s BETWEEN s AND e")
        sealed = "false" if low is None else f"end_s + {gap} < {low}L"
        marked = was.join(over.hint("merge"), inside, "left").selectExpr(*VERSION, f"if(u IS NULL, NULL, {batch}L) AS retracted_batch", "s AS retracted_start_s", f"{sealed} AS sealed")
        self.scratch.save(marked, f"standing/{batch}")
        self.done.append(batch)

    def versions(self) -> DataFrame:
        """Every version, with the batch and start of the one that retracted it, null where it is final."""
        gone = self._read("standing", self.done, "user long, batch long, start_s long, retracted_batch long, retracted_start_s long").where("retracted_batch IS NOT NULL")
        return self._read("versions", self.done, _SCHEMA).join(gone.hint("merge"), ["user", "batch", "start_s"], "left").select(*VERSION, "retracted_batch", "retracted_start_s")


def merge(events: DataFrame, gap: int = GAP, root: str | None = None) -> DataFrame:
    """All versions of the sessions of ``events`` (user, at, batch, value), batch after batch; value is added up as h_sum."""
    log = SessionLog(events.sparkSession, root, gap)
    # A second of a user is one row, however many events it has; batches are laid out in ranges of their own.
    each = events.where("user IS NOT NULL AND at IS NOT NULL AND batch IS NOT NULL").groupBy("batch", "user", "at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("value"))
    each = each.select(*[F.col(c).cast("long").alias(c) for c in ("batch", "user", "at", "n", "value")])
    each.repartitionByRange("batch", F.xxhash64("user")).write.mode("overwrite").partitionBy("batch").parquet(f"{log.scratch.root}/events")
    each = events.sparkSession.read.schema("user long, at long, n long, value long, batch long").parquet(f"{log.scratch.root}/events")
    spans = sorted(tuple(r) for r in each.groupBy("batch").agg(F.min("at"), F.max("at")).collect())
    origin = min((first for _, first, _ in spans), default=0)
    for i, (batch, _, _) in enumerate(spans):
        last = max(s[2] for s in spans[: i + 1])
        low = min((s[1] for s in spans[i + 1 :]), default=last + gap + 1)
        log.apply(batch, each.where(F.col("batch") == batch), origin, last, low)
    return log.versions()


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Events of ``conversations`` rows with a turn: user, at, batch and value from checksums of conversation and turn."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    c, h = F.crc32(conv.cast("string")), F.crc32(F.concat(conv.cast("string"), F.lit(":"), turn.cast("string")))
    rows = conversations.where("turn IS NOT NULL").select(conv.alias("conv"), turn.alias("turn"), c.alias("c"), h.alias("h"))
    at = F.expr("(c div 2) % 7200 + 300 * turn + h % 600")
    g = F.expr("h div 600")
    rows = rows.select((2 * F.shiftright("conv", 3) + F.col("c") % 2).alias("user"), at.alias("at"), g.alias("g"), F.col("h").alias("value"))
    hour = F.floor(F.col("at") / 3600)
    return rows.select("user", "at", "value", (hour + F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(0)).cast("long").alias("batch"))
