"""Approximate nearest neighbours with a hierarchical k-means tree.

Rows with equal vectors are one point, which keeps its smallest ids (``k + 1`` are
enough for any answer). The tree is fitted to a bounded sample of points: a node is
split by k-means into ``BRANCH`` children until it holds ``LEAF`` sample points or
``DEPTH`` is reached. Every point is then put into the leaf that descending to the
nearest centre gives.

A query walks the tree best bin first: a priority queue holds unopened branches by
the distance of their centre, and the leaf that comes out next is visited next.
How many leaves (by their share of the sample) must be visited is calibrated: with
sample points that the tree wasn't fitted to (``PROBES``, a tenth of the sample at most), against
brute force over the rest of the sample, visits are widened until the mean recall reaches ``TARGET``. A query widens further until its leaves
hold ``k`` points at least.

Points are stored in blocks of one leaf, ``BLOCK`` points at most; queries go to the
blocks of their leaves, in blocks as well, each pair of blocks gives its nearest
``k`` for each query, and these are merged. So neither a crowded leaf nor many equal
vectors meet in one task, no pair of rows is ever a row of a table, and the queries
may be as many as they like. What is broadcast is the tree, bounded by the sample.

Distances are Euclidean, in double precision, on the original vectors; ties go to
the smaller id. Vectors that are null, zero, empty or that hold null or non-finite
components take no part, as query or candidate. Those of different lengths have no distance: each
length is searched by itself, with a tree of its own. A query with fewer candidates than k gets all of them. Rows of equal id
and vector count once. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import Scratch, ship_package

BRANCH = 8
LEAF = 48
DEPTH = 6
SAMPLE = 20_000
PROBES = 200
TARGET = 0.95
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centres of Lloyd's algorithm from a k-means++ start."""
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    for _ in range(1, k):
        if near.max() <= 0:
            break
        centres.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    centres = np.array(centres)
    for _ in range(rounds):
        own = squared(x, centres).argmin(1)
        centres = np.array([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(len(centres))])
    return centres


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


class Tree:
    """Nodes with centres of their children; a child is a node (>= 0) or a leaf (~leaf). ``share``: sample points of each leaf."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.share: list[int] = []
        self.leaves = 0
        self.size = len(x)
        self.root = self._grow(x, 0, np.random.default_rng(seed))
        self.visits = 1.0

    def _grow(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        centres = kmeans(x, BRANCH, rng) if len(x) > LEAF and depth < DEPTH else x[:0]
        if len(centres) < 2:
            self.leaves += 1
            self.share.append(len(x))
            return ~(self.leaves - 1)
        node = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        own = squared(x, centres).argmin(1)
        self.children[node] = [self._grow(x[own == j], depth + 1, rng) for j in range(len(centres))]
        return node

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out[rows] = ~node
                continue
            own = squared(x[rows], self.centres[node]).argmin(1)
            todo += [(child, rows[own == j]) for j, child in enumerate(self.children[node])]
        return out

    def walk(self, q: np.ndarray):
        """Leaves, best bin first."""
        heap = [(0.0, self.root)]
        while heap:
            _, node = heapq.heappop(heap)
            if node < 0:
                yield ~node
            else:
                d = ((self.centres[node] - q) ** 2).sum(1)
                for j, child in enumerate(self.children[node]):
                    heapq.heappush(heap, (float(d[j]), child))

    def visited(self, q: np.ndarray, sizes: np.ndarray, k: int) -> list[int]:
        """The leaves that a query visits: the calibrated share of the sample, and k points at least."""
        out, share, points = [], 0, 0
        for leaf in self.walk(q):
            out.append(leaf)
            share += self.share[leaf]
            points += sizes[leaf]
            if share >= self.visits * self.size and points >= k:
                break
        return out

    def calibrate(self, x: np.ndarray, probes: np.ndarray, k: int, target: float) -> None:
        """Widens visits until ``probes`` find the share ``target`` of their nearest among the points ``x``."""
        own = self.leaf(x)
        true = np.argsort(squared(probes, x), axis=1, kind="stable")[:, :k]
        orders = [list(self.walk(p)) for p in probes]
        rank = np.empty((len(probes), self.leaves))
        for i, order in enumerate(orders):  # the share of the sample seen before each leaf
            rank[i, order] = np.cumsum([0, *[self.share[f] for f in order]])[:-1]
        seen = np.sort(np.concatenate([rank[i, own[t]] for i, t in enumerate(true)]))
        at = min(len(seen) - 1, int(np.ceil(target * len(seen))))
        self.visits = float(min(1.0, (seen[at] + 1) / len(x))) if len(seen) else 1.0


def _matrix(column) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def search(rows: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    data = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    data, out = data.where(good), None
    for r in data.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():  # a row for each length
        found = _search(data.where(F.size("v") == r["n"]), k, every, target)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(data: DataFrame, k: int, every: int, target: float) -> DataFrame:
    """``search`` of sound vectors (vec_id, v) of one length."""
    import pyarrow as pa

    spark = data.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    # One point for each vector, with its smallest ids: as many as any answer needs, and one for the query itself.
    least = Window.partitionBy("v").orderBy("vec_id")
    ids = data.distinct().withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    points = scratch.save(ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("point", F.col("ids")[0]), "points")
    # About as many as wanted by a threshold of the hash, so that no task sends more than its share; the limit cuts what is over.
    share = min(1.0, 1.1 * SAMPLE / max(1, points.count()))
    near = F.pmod(F.xxhash64("point", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True)
    x = _matrix(points.where(near).orderBy(F.xxhash64("point")).limit(SAMPLE).select("v").toArrow().column("v"))
    held = min(PROBES, len(x) // 10)
    tree = Tree(x[held:])
    tree.calibrate(x[held:], x[:held] if held else x, k, target)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("ids"), b.column("point"), pa.array(shared.value.leaf(_matrix(b.column("v"))))], names=["v", "ids", "point", "leaf"])

    placed = scratch.save(points.mapInArrow(place, "v array<double>, ids array<bigint>, point long, leaf long"), "placed")
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    count = np.array([sizes.get(f, 0) for f in range(tree.leaves)], np.int64)
    blocks = np.maximum(1, -(-count // BLOCK))
    plan = spark.sparkContext.broadcast((count, blocks))

    def spread(batches):
        """Each query to all blocks of the leaves that it visits."""
        for b in batches:
            m, ids = _matrix(b.column("v")), b.column("point").to_numpy()
            row, leaf, part = [], [], []
            for i, q in enumerate(m):
                for f in shared.value.visited(q, plan.value[0], k + 1):
                    n = plan.value[1][f]
                    row += [i] * n
                    leaf += [f] * n
                    part += range(n)
            yield pa.RecordBatch.from_arrays([b.column("v").take(pa.array(row, pa.int64())), pa.array(ids[row]), pa.array(leaf, pa.int64()), pa.array(part, pa.int32())], names=["v", "point", "leaf", "part"])

    asked = data.where(F.pmod("vec_id", F.lit(every)) == 0).distinct()
    queries = asked.groupBy("v").agg(F.min("vec_id").alias("point"))
    sent = queries.mapInArrow(spread, "v array<double>, point long, leaf long, part int")
    # Crowds of queries at a leaf meet its points in several groups as well; the number of groups is known from the counts.
    load = {r["leaf"]: r["n"] for r in sent.where("part = 0").groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame([(f, int(blocks[f]), max(1, -(-load.get(f, 0) // BLOCK))) for f in range(tree.leaves)], "leaf long, parts int, crowds int")
    mine = sent.join(F.broadcast(table), "leaf").select("leaf", "part", F.pmod(F.xxhash64("point"), F.col("crowds")).cast("int").alias("crowd"), "point", "v")
    theirs = placed.join(F.broadcast(table), "leaf").select("leaf", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), "v", "ids")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"point": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64()))})
        if not left.num_rows or not right.num_rows:
            return none
        q, c = _matrix(left.column("v")), _matrix(right.column("v"))
        ids, first = right.column("ids").combine_chunks(), np.array([x[0].as_py() for x in right.column("ids")])
        point, dist, got = [], [], []
        names = left.column("point").to_numpy()
        keep = min(k + 1, len(c))
        for lo in range(0, len(q), 256):
            rough = squared(q[lo : lo + 256], c)
            edge = np.partition(rough, keep - 1, axis=1)[:, keep - 1]
            for i in range(len(rough)):
                own = np.flatnonzero(rough[i] <= edge[i] + 1e-6 * (1 + edge[i]))  # exact distances decide among these
                d = np.sqrt(((c[own] - q[lo + i]) ** 2).sum(1))
                order = np.lexsort((first[own], d))[:keep]
                point += [names[lo + i]] * len(order)
                dist += d[order].tolist()
                got += own[order].tolist()
        return pa.table({"point": pa.array(point, pa.int64()), "d": pa.array(dist, pa.float64()), "ids": ids.take(pa.array(got, pa.int64()))})

    keys = ["leaf", "part", "crowd"]
    near = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(meet, "point long, d double, ids array<bigint>")
    best = near.select("point", "d", F.explode("ids").alias("vec_id"))
    nearest = Window.partitionBy("point").orderBy("d", "vec_id")
    best = best.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).select("point", "d", "vec_id", "r")
    own = asked.select(F.col("vec_id").alias("query_id"), "v").join(queries, "v").select("query_id", "point")
    answer = own.join(best, "point").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return answer.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))
