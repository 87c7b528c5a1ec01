"""Mixing sources to target weights along a time-varying curriculum.

Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share as
many words as all documents have. A target stops at ``CAP`` times its source's
words; the excess is shared by weight among the rest until none is above. That
fixed point is ``min(cap, level * weight)`` with one level for all, and the level
is the largest ``(total - capped so far) / (weight left)`` over the sources by
cap / weight, so one pass over the (few) sources finds it.

Within a source, documents are laid end to end in the order of a hash of doc_id,
as often as the target asks: every document ``target // words`` times, and those
in the first ``target % words`` words once more; the document at that boundary is
cut there. So a source's taken words are its target, rounded, and no document
gives more than ``CAP`` times its size.

The weight schedule of a source is linear in training time t in [0, 1], from
``1 - slope`` to ``1 + slope`` times its mean; its integral, the cumulative demand,
is ``target * (t + slope * (t*t - t))``, whose inverse gives each document the time
at which each of its copies is due (``positions``, one for each round; the first is
``position``; null if not taken). The result is range-sorted by the first; exploded
and sorted by position, the copies follow the whole schedule.

Sums of words run over (source, hash bucket) first and then inside a bucket, so no
window holds more than 1 / ``BUCKETS`` of a source. Texts are shuffled for ``copies`` alone.

Null and empty texts have 0 words and take 0. A null doc_id is laid like the text
``null``. Repeated rows are rows of their own, in any order among equals. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import Scratch

CAP = 3
BUCKET_HEX = 3  # 4096 buckets
SLOPE = 0.5
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP, slope: float = SLOPE) -> DataFrame:
    """By source (column ``sk``, with ``source_size``): weight, target and slope. One row for each source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy("sk")
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sk")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("r", F.row_number().over(by_name) - 1)
        .withColumn("weight", (F.col("r") % 3 + 1).cast("long"))
        .withColumn("slope", F.when(F.col("r") % 2 == 0, F.lit(float(slope))).otherwise(F.lit(-float(slope))))
        .withColumn("cap", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.max((F.col("total") - F.col("capped")) / F.col("left")).over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("sk", "source_size", "weight", "target", "slope")
    )


def _source(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _place(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("null")))


def lay(docs: DataFrame, cap: int = CAP, slope: float = SLOPE, key: str = "doc_id", text: str = "text", source: str = "source", whole: bool = False) -> DataFrame:
    """Each row's place among its source's words (``at``), whole rounds, extra words of the last round, taken and copies; ``whole``: with all of the row as ``row``."""
    place = _place(F.col(key))
    laid = [F.col(key).alias("doc_id"), words(F.col(text)).alias("size"), _source(F.col(source)).alias("sk"), place.alias("place"), F.substring(place, 1, BUCKET_HEX).alias("bucket")]
    rows = Scratch(docs.sparkSession).save(docs.select(*laid), "sizes")  # texts are read once; sums, ranks and the final sort read these
    sums = rows.groupBy("sk", "bucket").agg(F.sum("size").alias("n"))
    per = targets(sums.groupBy("sk").agg(F.sum("n").alias("source_size")), cap, slope)
    start = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.withColumn("start", F.coalesce(F.sum("n").over(start), F.lit(0))).join(per, "sk").drop("n")
    order = ["place", "doc_id", "size"]
    if whole:  # texts go to their buckets along with their rows, so that each row has its own place
        rows, order = docs.select(*laid, F.crc32(F.col(text)).alias("crc"), F.struct(*docs.columns).alias("row")).where("size > 0"), [*order, "crc"]
    inside = Window.partitionBy("sk", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.floor(F.col("target") + 0.5).cast("long")
    return (
        rows.join(buckets, ["sk", "bucket"])
        .withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0).cast("long")))
        .withColumn("more", asked - F.col("rounds") * F.col("source_size"))
        .withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("more") - F.col("at"))))
        .withColumn("taken", F.col("rounds") * F.col("size") + F.col("extra"))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("rounds") + F.when(F.col("extra") > 0, 1).otherwise(0)).otherwise(F.lit(0)).cast("int"))
    )


def timed(laid: DataFrame, slope: float = SLOPE) -> DataFrame:
    """``laid`` with the times at which the copies of each row are due: ``positions``, null without copies."""
    b = F.lit(1.0) - F.col("slope")  # slope*t^2 + (1 - slope)*t = share

    def due(round_: Column) -> Column:
        share = (F.col("at") + round_ * F.col("source_size")) / F.col("target")
        time = share if slope == 0 else (F.sqrt(b * b + F.lit(4.0) * F.col("slope") * share) - b) / (F.lit(2.0) * F.col("slope"))
        return time + F.lit(0.0)

    return laid.withColumn("positions", F.when((F.col("copies") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0), F.col("copies") - 1), due)))


def mix(docs: DataFrame, cap: int = CAP, slope: float = SLOPE, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position, positions; sorted by position."""
    return (
        timed(lay(docs, cap, slope, key, text, source), slope)
        .withColumn("position", F.get("positions", F.lit(0)))
        .select("doc_id", "size", "source_size", "target", "taken", "copies", "position", "positions")
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


def copies(docs: DataFrame, cap: int = CAP, slope: float = SLOPE, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix takes it, a part counting as once; the copies are sorted by the times at which they are due.

    Texts are shuffled twice, to the buckets of their sources and into the order of time.
    """
    laid = timed(lay(docs, cap, slope, key, text, source, whole=True), slope).where(F.col("copies") > 0)
    return laid.select("row", "place", F.explode("positions").alias("position")).orderBy("position", "place").select("row.*")
