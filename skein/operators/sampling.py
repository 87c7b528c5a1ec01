"""Samples of articles and of question-answer pairs, in input order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.rules import article_category
from skein.functions.text import strip
from skein.sources.lines import numbered_lines

MIN_TEXT, PER_CATEGORY, MOST_DOCS, MOST_CASES = 180, 5, 20, 30


def iso_date(raw):
    """The date of an ISO timestamp, else the first ten characters."""
    iso = raw.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    return F.coalesce(F.when(iso, F.date_format(F.try_to_timestamp(raw), "yyyy-MM-dd")), F.substring(raw, 1, 10))


def articles(rows: DataFrame) -> DataFrame:
    """Raw articles (line, id, title, text, source, time) as documents; incomplete and short ones are dropped."""
    s = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    x = rows.select("line", s("id").alias("raw_id"), s("title").alias("title"), s("text").alias("content"), s("source").alias("source"), s("time").alias("time"))
    x = x.where((F.col("title") != "") & (F.col("raw_id") != "") & (F.col("time") != "") & (F.length("content") >= MIN_TEXT))
    return x.select(
        "line", F.concat(F.lit("demo_"), F.when(F.col("line") < 10_000, F.lpad(F.col("line").cast("string"), 4, "0")).otherwise(F.col("line").cast("string"))).alias("doc_id"), "title",
        F.when(F.col("source") == "", "unknown").otherwise(F.col("source")).alias("source"), iso_date(F.col("time")).alias("date"), article_category(F.col("title"), F.col("content")).alias("category"), "content",
    )


def sample_articles(docs: DataFrame, per_category: int = PER_CATEGORY, most: int = MOST_DOCS) -> DataFrame:
    """Greedy sample in line order: no general ones, a title once, ``per_category`` of each category and ``most`` in all.

    A title counts as seen only once it was taken, so the choice is a fold over the
    lines. What can't be chosen is dropped before it, without changing the choice:
    of one (category, title) only the first line can ever be taken, and of a category
    at most ``per_category`` titles plus those that other categories took before (fewer
    than ``most``). So the fold reads (per_category + most) rows of each category.
    """
    first = Window.partitionBy("category", "title").orderBy("line")
    x = docs.where(F.col("category") != "general").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy("category").orderBy("line"))).where(F.col("__n") <= per_category + most).drop("__n")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, count, titles = [], {}, set()
        for i, r in enumerate(pdf.sort_values("line").itertuples(index=False)):
            if len(taken) < most and r.title not in titles and count.get(r.category, 0) < per_category:
                taken.append(i)
                titles.add(r.title)
                count[r.category] = count.get(r.category, 0) + 1
        return pdf.sort_values("line").iloc[taken]

    picked = x.select("line", "category", "title").groupBy(F.lit(1).alias("all")).applyInPandas(lambda pdf: fold(pdf[["line", "category", "title"]]), "line long, category string, title string")
    return docs.join(F.broadcast(picked.select("line")), "line", "left_semi")


def sample_cases(pairs: DataFrame, position: str, most: int = MOST_CASES) -> DataFrame:
    """Every (n / most)-th pair by position, repeated questions once, renumbered q1, q2, ...

    The number of each pair comes from counts of ranges of positions, not from one window over all.
    """
    n = pairs.count()
    step = max(n // most, 1)
    numbered = _numbered(pairs, position)
    x = numbered.where(F.col("__i") % step == 0)
    x = x.withColumn("__n", F.row_number().over(Window.partitionBy("question").orderBy("__i"))).where("__n = 1")
    x = x.orderBy("__i").limit(most)
    x = x.withColumn("__q", F.row_number().over(Window.orderBy("__i")))  # ``most`` rows
    return x.select(F.concat(F.lit("q"), F.col("__q").cast("string")).alias("qid"), "question", F.lit("qa").alias("task_type"), F.col("answer").alias("reference_answer"), position)


def _numbered(rows: DataFrame, position: str, blocks: int = 1024) -> DataFrame:
    """``rows`` with ``__i`` from 0 in the order of an integer column: ranks inside equal ranges, plus the counts before."""
    lo, hi = rows.agg(F.min(position), F.max(position)).first()
    if lo is None:
        return rows.withColumn("__i", F.lit(0).cast("long"))
    width = max(1, -(-(hi - lo + 1) // blocks))
    x = rows.withColumn("__b", F.floor((F.col(position) - lo) / width).cast("int"))
    before = x.groupBy("__b").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(position)) - 1
    return x.withColumn("__r", inside).join(F.broadcast(before.select("__b", "__before")), "__b").withColumn("__i", F.col("__before") + F.col("__r")).drop("__b", "__r", "__before")


def line_numbers(path: str, spark) -> DataFrame:
    """(line, value) of text files with physical line numbers from 1 in each, blank lines counted."""
    return numbered_lines(spark, path).select(F.col("number").alias("line"), "value")
