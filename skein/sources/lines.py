"""Lines of text files with their physical numbers, read by as many tasks as a file has splits.

Spark cuts a large file into byte ranges. A range's rows come in order, so the number of a
line is the count of lines in the ranges before it plus its place in its own. One pass
counts the lines of every range (a row for each goes through one sum), the next reads the
lines; none are shuffled or sorted. Should the passes see other ranges (a file was written to,
or executors came between them and the default size of a range changed), a row falls outside
its range and the job fails with an error that says so; no number is ever wrong.

Lines end at a newline, a carriage return or both; blank ones count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges whose counts are broadcast; of more, they are joined by a shuffle.
MOST_RANGES = 200_000
#: Rows within a task, the lower bits of Spark's increasing ids.
_WITHIN = (1 << 33) - 1


def numbered_lines(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """(file, number, line, value): number counts the lines of a file from 1, line those of all files in the order of their names."""
    rows = spark.read.text(path).select(
        F.col("value").alias(value),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN)).alias("__at"),
    )
    ranges = rows.groupBy("file", "__start").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.orderBy("file", "__start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("file", "__start", "__first", "__n", before(Window.partitionBy("file")).alias("__number"), before(Window.partitionBy()).alias("__line"))
    joined = rows.join(F.broadcast(ranges) if _ranges(spark, path) <= MOST_RANGES else ranges, ["file", "__start"], "left")
    place = F.col("__at") - F.col("__first") + 1
    sound = F.coalesce(place.between(1, F.col("__n")), F.lit(False))
    changed = F.raise_error(F.concat(F.lit("the byte ranges changed between two reads of "), F.col("file"))).cast("long")
    number = lambda first: F.when(sound, F.col(first) + place).otherwise(changed)
    return joined.select("file", number("__number").alias("number"), number("__line").alias("line"), value)


def _ranges(spark: SparkSession, path: str) -> int:
    """How many byte ranges the files have, about: their bytes by the size of a range, and one a file."""
    read = spark.read.text(path)
    size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size // (4 << 20) + len(read.inputFiles())
