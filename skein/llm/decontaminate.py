"""Benchmark decontamination by spaced seeds.

Texts become lower-case words, what lies between ASCII spaces, punctuation and control characters.
A mask looks at four positions of a window and ignores those between. Every window of every document
is hashed under each mask and joined with the same hashes of all benchmark items. An item is found in
a document if some ``WINDOW`` aligned words (all of the item, if it has fewer) agree in at least
``AGREE`` of them. The masks together leave no such alignment without a hit, wherever its words differ:
two are enough for windows of ``WINDOW`` words, three for any from ``SHORTEST`` on (a test tries all
patterns). Four is the most positions for which there is such a family for the short ones.

1. Hits are (document, item, lag), each once, however many windows of a copied passage agree.
2. The texts of what was hit are read again and cut to the aligned words, which are compared.

A document's words go along with none of its hits, so work and memory grow with the length of a text.
The item hashes, and the hits, are broadcast if they are ``BROADCAST_ROWS`` at most, rows of a few
numbers and keys; above that they are joined by a shuffle.

Items of fewer than ``SHORTEST`` words match nothing. Null and empty texts match nothing. Repeated
rows and copies are found each, rows of equal doc_id together, those without one too. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.storage import Scratch

#: For windows of WINDOW words, and for any.
LONG_MASKS = ((0, 1, 2, 4), (0, 1, 3, 6))
MASKS = ((0, 1, 3, 4), (0, 2, 3, 5), (0, 1, 5, 6))
SHORTEST = 6
WINDOW = 16
AGREE = 0.75
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"), F.lit(0))


def seeds(df: DataFrame, masks: tuple) -> DataFrame:
    """The columns of ``df`` but ``words``, by position ``at`` and seed hash of its windows."""

    def under(i: int, mask: tuple[int, ...]) -> Column:
        last = F.size("words") - 1 - mask[-1]
        one = lambda at: F.struct(at.alias("at"), F.xxhash64(F.lit(i), *[F.get("words", at + o) for o in mask]).alias("seed"))
        none = F.expr("cast(array() as array<struct<at:int,seed:bigint>>)")
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(none)

    every = F.flatten(F.array(*[under(i, m) for i, m in enumerate(masks)]))
    # The outer form infers no filter, which would make all seeds twice.
    return df.select(*[c for c in df.columns if c != "words"], F.inline_outer(every)).where("seed is not null")


def best_window(equal: Column, wide: Column) -> Column:
    """Most agreeing words in any window of ``wide`` aligned words."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(equal) - wide + 1))
    return F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice(equal, i, wide), F.lit(0), lambda a, x: a + x)))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, agree: float = AGREE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, n_equal, n_window, doc_at, item_at (word offsets of the alignment)."""
    tests = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item_id"), words(F.col(item_text)).alias("words")).where(F.size("words") >= SHORTEST)
    short = bool(tests.where(F.size("words") < window).limit(1).count())
    masks = MASKS if short or window < WINDOW else LONG_MASKS
    probes = seeds(tests.withColumn("n", F.size("words")), masks).withColumnRenamed("at", "item_pos")
    small = probes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), words(F.col(text)).alias("words"))
    hits = seeds(texts, masks).join(F.broadcast(probes) if small else probes, "seed")
    hits = hits.groupBy("doc_id", "item_id", "n", (F.col("at") - F.col("item_pos")).alias("lag")).agg(F.lit(1).alias("hit"))
    hits = Scratch(docs.sparkSession).save(hits.select(F.col("doc_id").alias("__doc"), F.col("item_id").alias("__item"), "n", "lag"), "hits")
    few = hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    skip_doc, skip_item = F.greatest(F.col("lag"), F.lit(0)), F.greatest(-F.col("lag"), F.lit(0))
    length = F.least(F.size("words") - skip_doc, F.col("n") - skip_item)
    cut = texts.join(F.broadcast(hits) if few else hits, F.col("doc_id").eqNullSafe(F.col("__doc")))
    cut = cut.select("doc_id", "__item", "n", skip_doc.alias("doc_at"), skip_item.alias("item_at"), F.slice("words", skip_doc + 1, F.greatest(length, F.lit(0))).alias("a"))
    tests = tests.withColumnRenamed("words", "b")
    both = cut.join(F.broadcast(tests) if small else tests, F.col("__item").eqNullSafe(F.col("item_id")) & (F.col("n") == F.size("b")))
    # inline() keeps the slice out of the interpreted comparison below.
    aligned = F.struct("doc_at", "item_at", F.least(F.lit(window), F.col("n")).alias("n_window"), "a", F.slice("b", F.col("item_at") + 1, F.size("a")).alias("b"))
    equal = F.zip_with("a", "b", lambda a, b: F.when(a == b, 1).otherwise(0))
    tried = both.select("doc_id", "item_id", F.inline(F.array(aligned))).withColumn("n_equal", best_window(equal, F.col("n_window")))
    good = tried.where(F.col("n_equal") >= F.ceil(F.lit(agree) * F.col("n_window")))
    # The best alignment: most agreeing words, then the leftmost.
    order = F.struct("n_equal", (-F.col("doc_at")).alias("doc_at"), (-F.col("item_at")).alias("item_at"), "n_window")
    best = good.groupBy("doc_id", "item_id").agg(F.max(order).alias("m"))
    return best.select("doc_id", "item_id", "m.n_equal", "m.n_window", (-F.col("m.doc_at")).alias("doc_at"), (-F.col("m.item_at")).alias("item_at"))
