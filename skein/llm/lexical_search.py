"""Ranked lexical search of whole tables of questions: variable-block-max WAND in shards.

``search`` ranks all documents for each item:

1. The terms of the items are collected (in parts of about ``MOST_TERMS`` pairs of
   item and term, each a pass of its own, so what is broadcast is bounded).
2. One pass over the texts keeps, for each document, its number of terms and how
   often each asked term occurs in it; the result is a table in the shared folder.
   Document frequencies, the number of documents and the sum of their lengths are
   Spark aggregates over all of it.
3. Every task cuts its rows into shards of about ``POSTINGS`` postings and keeps
   its own k best for each item; no postings are shuffled. A window merges the k
   best of all tasks.

In a shard each term has a list of postings by ascending document. Its list is cut
into blocks by dynamic programming over runs of ``ATOM`` postings: of all partitions
with at most ``WIDEST`` runs a block, the one is taken that minimises the sum of
(largest score of the block - score) over its postings plus a fixed cost a block.
All lists of a shard are solved side by side, step by step in numpy.

A search goes through the shard in the order of documents. Between two block edges
the largest scores of an item's current blocks are constant; where their sum is
below the score of the item's k-th best so far, the whole stretch is skipped. In
what is left, a document is a pivot, and scored, only where the bounds of the
blocks that hold it reach that score. All stretches of a run are tested at once, and
runs grow, as the bar rises quickly. The bar goes on from shard to shard of a task.
Only what can't be among the k best is left out, so the result is exact.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z
lower-cased, known by a 64-bit hash; null and empty texts have none, and documents
without terms count for nothing and are never found. Scores are integers (``weights``
and ``impact``). Equal scores go by ascending doc_id, null last; repeated rows are
documents of their own, each with a rank. Rows of one item_id are one item, null
included, with the terms of all of them. Items without a match have no rows, and an
empty table on either side gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import tokens
from skein.storage import Scratch, ship_package

K = 10
MOST_TERMS = 1_000_000
POSTINGS = 1_000_000
ATOM = 8
WIDEST = 16
BLOCK_COST = 32  # a block costs as much as the mean error of its list does over so many postings
FIRST_RUN = 512  # documents of the first run of a shard


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """How much a term that occurs tf times counts in a document of n terms, of ``documents`` with ``terms`` in all."""
    m = 10 + (90 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def cut_blocks(score: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the blocks start, given the scores of the postings of all lists and the lists' bounds."""
    size = np.diff(bounds)
    lists = np.flatnonzero(size)
    order = lists[np.argsort(-size[lists], kind="stable")]
    runs = -(-size[order] // ATOM)
    if not len(order):
        return np.zeros(0, np.int64)
    off = np.concatenate([[0], np.cumsum(runs)])
    step = np.arange(off[-1]) - np.repeat(off[:-1], runs)
    start = np.repeat(bounds[:-1][order], runs) + step * ATOM
    # Runs of all lists, longest list first; reduceat wants ascending starts, so it works on sorted ones.
    asc = np.argsort(start, kind="stable")
    most, total = np.empty(len(start), np.float64), np.empty(len(start), np.float64)
    most[asc] = np.maximum.reduceat(score, start[asc])
    total[asc] = np.add.reduceat(score, start[asc])
    count = np.minimum(ATOM, np.repeat(bounds[1:][order], runs) - start)
    # Sums before each run, one more entry than runs a list.
    at = off + np.arange(len(off))
    sums, counts = np.zeros(at[-1] + 1), np.zeros(at[-1] + 1, np.int64)
    inner = np.repeat(at[:-1], runs) + step
    for out, add in ((sums, total), (counts, count)):
        running = np.cumsum(add)
        out[inner + 1] = running - np.repeat(np.concatenate([[0], running])[off[:-1]], runs)
    cost = BLOCK_COST * (np.maximum.reduceat(most, off[:-1]) - sums[at[1:] - 1] / size[order])
    best, back = np.zeros(len(sums)), np.zeros(len(sums), np.int64)
    alive = np.searchsorted(-runs, -np.arange(1, runs[0] + 1), "right")  # lists of t runs at least
    high = np.full((len(order), WIDEST), -np.inf)
    for t in range(1, runs[0] + 1):
        n, k = alive[t - 1], min(t, WIDEST)
        new = most[off[:n] + t - 1]
        high[:n, 1:] = high[:n, :-1]
        high[:n, 0] = new
        np.maximum(high[:n], new[:, None], out=high[:n])
        here = at[:n] + t
        from_ = here[:, None] - np.arange(1, k + 1)
        total_cost = best[from_] + high[:n, :k] * (counts[here][:, None] - counts[from_]) - (sums[here][:, None] - sums[from_])
        pick = total_cost.argmin(1)
        best[here] = total_cost[np.arange(n), pick] + cost[:n]
        back[here] = pick + 1
    first = np.zeros(len(start), bool)
    left, which = runs.copy(), np.arange(len(order))
    while len(which):
        left[which] -= back[at[which] + left[which]]
        first[off[which] + left[which]] = True
        which = which[left[which] > 0]
    return np.sort(start[first])


class Shard:
    """Postings of the documents 0 to ``size`` - 1, cut into blocks."""

    def __init__(self, size: int, doc: np.ndarray, term: np.ndarray, score: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")  # documents come in ascending order
        self.size, self.doc, self.score = size, doc[order], score[order]
        self.bounds = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.start = cut_blocks(self.score, self.bounds)
        end = np.append(self.start[1:], len(self.doc))
        self.block_max = np.maximum.reduceat(self.score, self.start) if len(self.start) else np.zeros(0, np.int64)
        self.bound = np.repeat(self.block_max, end - self.start)
        self.low, self.high = self.doc[self.start], self.doc[end - 1] + 1 if len(end) and len(self.doc) else np.zeros(0, np.int64)
        self.block_of_list = np.searchsorted(self.start, self.bounds)
        self.scored = 0  # documents that were scored, for measurements

    def best(self, terms: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with ``bar`` or more (0: any score above 0), best first, ties by document."""
        terms = terms[self.bounds[terms + 1] > self.bounds[terms]]
        found, points = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return found, points
        blocks = np.concatenate([np.arange(self.block_of_list[t], self.block_of_list[t + 1]) for t in terms])
        gain = np.zeros(self.size + 1, np.int64)
        np.add.at(gain, self.low[blocks], self.block_max[blocks])
        np.subtract.at(gain, self.high[blocks], self.block_max[blocks])
        reach = np.cumsum(gain[:-1])  # the sum of the current blocks' largest scores, document by document
        lists = [(self.doc[self.bounds[t] : self.bounds[t + 1]], self.bounds[t]) for t in terms]
        exact = int(sum(self.block_max[self.block_of_list[t] : self.block_of_list[t + 1]].max() for t in terms)) < 1 << 53
        lo, run = 0, FIRST_RUN
        while lo < self.size:
            hi = min(self.size, lo + run)
            live = reach[lo:hi] >= max(bar, 1)
            if live.any():
                at = np.concatenate([np.arange(*np.searchsorted(d, (lo, hi))) + first for d, first in lists])
                at = at[live[self.doc[at] - lo]]
                own = self.doc[at] - lo
                pivot = _sums(own, self.bound[at], hi - lo, exact) >= max(bar, 1)
                at = at[pivot[own]]
                self.scored += int(pivot.sum())
                score = _sums(self.doc[at] - lo, self.score[at], hi - lo, exact)
                good = np.flatnonzero(score >= max(bar, 1))
                found, points = np.concatenate([found, good + lo]), np.concatenate([points, score[good]])
                top = np.lexsort((found, -points))[:k]
                found, points = found[top], points[top]
                if len(points) == k:
                    bar = max(bar, int(points[-1]))
            lo, run = hi, run * 2
        return found, points


def _sums(at: np.ndarray, values: np.ndarray, size: int, exact: bool) -> np.ndarray:
    if exact:  # all sums are whole numbers that doubles hold
        return np.bincount(at, values, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values)
    return out


def _terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, term) of every row, terms as hashes, each once for an item."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, offs in tokens.blocks(b.column("__text")):
                w = tokens.Words(data, offs, tokens.ALNUM)
                row = np.repeat(np.arange(len(offs) - 1), np.diff(w.bounds)) + lo
                yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(row)), pa.array(w.hash.view(np.int64))], names=["item_id", "term"])

    rows = rows.select(F.col(key).alias("item_id"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term long").distinct()


def _occurrences(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term: how many it has, which of the vocabulary and how often."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            for lo, hi, data, offs in tokens.blocks(b.column("__text")):
                w = tokens.Words(data, offs, tokens.ALNUM)
                n = np.diff(w.bounds)
                at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
                hit = known[at] == w.hash
                pair, tf = np.unique(np.repeat(np.arange(hi - lo), n)[hit] * len(known) + at[hit], return_counts=True)
                ends = np.searchsorted(pair // len(known), np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (pair % len(known), tf)]
                out = pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n), *lists], names=["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tf array<int>")


def _best_of_tasks(rows: DataFrame, items, starts: np.ndarray, terms: np.ndarray, weight: np.ndarray, documents: int, length: int, k: int, postings: int) -> DataFrame:
    """The k best documents of each task for each item: (item_id, doc_id, score)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    shared = rows.sparkSession.sparkContext.broadcast((items, starts, terms, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, starts, terms, weight = shared.value
        best: list[list[tuple]] = [[] for _ in range(len(items))]

        def search(part: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(part)
            table = table.take(pc.sort_indices(table.column("doc_id"), null_placement="at_end")).combine_chunks()
            ids, n = table.column("doc_id").to_pylist(), table.column("n").to_numpy()
            held = table.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(n)), pc.list_value_length(held).to_numpy(zero_copy_only=False))
            term, tf = held.flatten().to_numpy(), table.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            score = weight[term] * impact(tf, n[doc], documents, length)
            some = score > 0
            shard = Shard(len(n), doc[some], term[some], score[some], len(weight))
            for i, top in enumerate(best):
                bar = -top[-1][0] if len(top) == k else 0
                found, points = shard.best(terms[starts[i] : starts[i + 1]], k, bar)
                if len(found):
                    new = [(-int(p), ids[d] is None, ids[d]) for d, p in zip(found, points, strict=True)]
                    best[i] = sorted(top + new, key=lambda r: r[:2] if r[1] else r)[:k]

        part, held = [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                piece = b.slice(lo, 1000)
                part.append(piece)
                held += len(piece.column("terms").flatten())
                if held >= postings:
                    search(part)
                    part, held = [], 0
        if held:
            search(part)
        which = [i for i, top in enumerate(best) for _ in top]
        rows = [r for top in best for r in top]
        if rows:
            kind = schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays([items.take(pa.array(which)), pa.array([r[2] for r in rows], kind), pa.array([-r[0] for r in rows], pa.int64())], names=["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_schema, from_arrow_type

    schema = to_arrow_schema(rows.select("doc_id").schema)
    kinds = from_arrow_type(items.type).simpleString(), rows.schema["doc_id"].dataType.simpleString()
    return rows.where(F.size("terms") > 0).mapInArrow(run, f"item_id {kinds[0]}, doc_id {kinds[1]}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "text", most_terms: int = MOST_TERMS, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, best first."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark = docs.sparkSession
    ship_package(spark)
    scratch, out = Scratch(spark), None
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    asked = scratch.save(_terms(items, item, question), "asked")
    parts = max(1, -(-asked.count() // most_terms))
    for part in range(parts):
        # Whole items, dealt by hash, so a part holds about most_terms pairs; an item of more has a part that large.
        got = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "term").toArrow()
        if not got.num_rows:
            continue
        coded = got.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        vocabulary, terms = np.unique(got.column("term").to_numpy().view(np.uint64), return_inverse=True)
        starts = np.searchsorted(coded.indices.to_numpy(), np.arange(len(coded.dictionary) + 1))
        hits = scratch.save(_occurrences(docs, vocabulary), f"hits_{part}")
        total = hits.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not total["n"]:
            break
        ratio = F.lit(2.0 * total["n"] + 2.0) / (2.0 * F.count(F.lit(1)) + 1.0)
        each = hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.floor(1000 * F.log(ratio)).cast("long").alias("w")).toArrow()
        weight = np.zeros(len(vocabulary), np.int64)
        weight[each.column("term").to_numpy()] = each.column("w").to_numpy()
        found = _best_of_tasks(hits.select("doc_id", "n", "terms", "tf"), coded.dictionary, starts, terms, weight, total["n"], total["l"], k, postings)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item_id {items.schema[item].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
