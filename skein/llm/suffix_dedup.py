"""Repeated passages by a sparse suffix array.

A passage is ``LEAST`` words or more that stand, word for word (A-Z lower-cased),
in two documents or more. Of all suffixes those are kept that start at a minimiser:
the smallest hash of ``GRAM`` words among ``LEAST - GRAM + 1`` in a row. So any
``LEAST`` repeated words hold a kept suffix at the same place in each document,
and that choice depends on the words there alone.

1. Each task counts in how many documents the first ``GRAM`` words of its kept
   suffixes occur; a bitmap of ``BITS`` bits at most marks those that repeat.
2. A marked suffix is described by its context: its first ``GRAM`` words and those
   around it that the stretches of ``LEAST`` words reach whose minimiser it is. Equal
   contexts are one, with the smallest and the largest document that has it, combined
   on each task first, so copies are compared once.
3. Contexts are gathered by their first ``GRAM`` words. They are sorted, neighbours are
   compared, and a common prefix is extended to the left. A neighbour may share more to
   the right and less to the left than another context, so these stretches are sorted
   too; together this finds every repeated stretch.
4. What is found goes back to the rows of each context and is merged to maximal
   passages of each document.

First words with more than ``HOT`` contexts (a common passage amid different texts), or
with ``CROWD`` times as many places, aren't gathered: their contexts are combined by an
aggregate, and their stretches are aggregated by hash. At most ``HOT_KEYS`` such words
are broadcast; beyond that ``HOT`` doubles.

Texts that are null, empty or shorter than ``LEAST`` words have no passages. Rows of
equal doc_id are one document (so are all rows without one): what repeats only
inside it doesn't count. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm import tokens
from skein.storage import Scratch, ship_package

LEAST = 50
GRAM = 25
REACH = LEAST - GRAM
BITS = 1 << 26
HOT = 20_000
CROWD = 10
HOT_KEYS = 200_000
CONTEXTS = 100_000
PER_SHARD = 25_000
FLUSH = 2_000_000
_NONE = -(1 << 63)


def _extreme(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each ``width`` consecutive values."""
    done, step = x, 1
    while 2 * step <= width:
        done, step = f(done[:-step], done[step:]), 2 * step
    return f(done[: len(done) - (width - step)], done[width - step :]) if step < width else done


def sampled(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the kept suffixes among the words, hashes of their first words, least hash in the stretch from each word on or 0)."""
    none = np.zeros(0, np.uint64)
    if len(hashes) < LEAST:
        return np.zeros(0, np.int64), none, none
    with np.errstate(over="ignore"):
        gram = hashes[: len(hashes) - GRAM + 1] * tokens._STEP[0]
        for k in range(1, GRAM):
            gram = gram + hashes[k : len(hashes) - GRAM + 1 + k] * tokens._STEP[k]
    gram = tokens.mix(gram) | np.uint64(1)
    window = _extreme(gram, REACH + 1, np.minimum)  # from each word on, over LEAST words
    end = np.repeat(bounds[1:], np.diff(bounds))[: len(window)]
    window = np.where(np.arange(len(window)) + LEAST <= end, window, np.uint64(0))
    padded = np.concatenate([np.zeros(REACH, np.uint64), window, np.zeros(REACH, np.uint64)])
    at = np.flatnonzero(_extreme(padded, REACH + 1, np.maximum) == gram)
    return at, gram[at], window


def _ids(column) -> np.ndarray:
    return column.cast("int64").fill_null(_NONE).to_numpy(zero_copy_only=False)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def repeated(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """(bitmap, shift to its bits) of the prefixes that occur in two documents or more."""
    import pyarrow as pa

    buckets = max(16, 1 << int(np.ceil(np.log2(max(1, size * 0.015 / 500_000)))))
    bits = int(min(BITS, max(1 << 18, 1 << int(np.ceil(np.log2(max(1, size * 0.2)))))))
    lead = np.uint64(64 - int(np.log2(buckets)))
    shift = 64 - int(np.log2(bits))
    per = bits // buckets

    def emit(parts):
        """By bucket the prefixes that occur once here, and those that occur more often."""
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        cut = np.searchsorted((keys >> lead).astype(np.int64), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut))
        split = [(keys[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]]) for b in some]
        return pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array([k[n == 1].tobytes() for k, n in split], pa.binary()), pa.array([k[n > 1].tobytes() for k, n in split], pa.binary())],
            names=["bucket", "once", "more"],
        )

    def count(batches):
        parts, held = [], 0
        for batch in batches:
            for _, _, data, offs in tokens.blocks(batch.column("text")):
                w = tokens.Words(data, offs)
                at, key, _ = sampled(w.hash, w.bounds)
                row = np.searchsorted(w.bounds, at, "right") - 1
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                parts.append(key[_starts(key, row)])
                held += len(parts[-1])
                if held >= FLUSH:
                    yield emit(parts)
                    parts, held = [], 0
        if held:
            yield emit(parts)

    def total_up(table: pa.Table) -> pa.Table:
        join = lambda name: np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint64)
        once, more = join("once"), join("more")
        keys = np.sort(np.concatenate([once, more, more]))
        keys = keys[1:][keys[1:] == keys[:-1]]
        bucket = table.column("bucket")[0].as_py()
        flags = np.zeros(per, np.uint8)
        flags[(keys >> np.uint64(shift)).astype(np.int64) - bucket * per] = 1
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "bucket int, once binary, more binary")
    found = rows.groupBy("bucket").applyInArrow(total_up, "bucket int, bits binary").toPandas()
    flags = np.zeros(bits // 8, np.uint8)
    for b, x in zip(found["bucket"], found["bits"], strict=True):
        flags[b * per // 8 : (b + 1) * per // 8] = np.frombuffer(x, np.uint8)
    return flags, shift


def marked(w: tokens.Words, flags: np.ndarray, shift: int) -> tuple[np.ndarray, ...]:
    """The marked suffixes: row, place in it, key, ctx, span and words around.

    The stretches of LEAST words whose minimiser a suffix is start between span // 32 and span % 32 words before it.
    Around has the words that these reach: to the right, then backwards to the left, zero beyond. ctx is a hash of all.
    """
    at, key, window = sampled(w.hash, w.bounds)
    bit = (key >> np.uint64(shift)).astype(np.int64)
    own = np.flatnonzero((flags[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
    at, key = at[own], key[own]
    row = np.searchsorted(w.bounds, at, "right") - 1
    left = np.minimum(at - w.bounds[row], REACH)
    near, most, least = np.zeros((len(at), 2 * REACH), ">u4"), np.zeros(len(at), np.int64), np.full(len(at), REACH, np.int64)
    for t in range(REACH + 1):
        s = at - t
        good = (t <= left) & (s < len(window))
        good &= window[np.clip(s, 0, max(len(window) - 1, 0))] == key if len(window) else False
        most, least = np.where(good, t, most), np.where(good, np.minimum(least, t), least)
    word = np.concatenate([np.zeros(REACH, np.uint32), (w.hash >> np.uint64(32)).astype(np.uint32), np.zeros(LEAST, np.uint32)])
    for j in range(REACH):
        near[:, j] = np.where(j < REACH - least, word[REACH + at + GRAM + j], 0)
        near[:, REACH + j] = np.where(j < most, word[REACH + at - 1 - j], 0)
    span = 32 * least + most
    with np.errstate(over="ignore"):
        ctx = key ^ span.astype(np.uint64)
        for j in range(2 * REACH):
            ctx = ctx + (near[:, j].astype(np.uint64) + np.uint64(1)) * tokens._STEP[j]
    return row, (at - w.bounds[row]).astype(np.int32), key, tokens.mix(ctx), span.astype(np.int32), near


def suffixes(docs: DataFrame, flags, shift: int) -> DataFrame:
    """(key, ctx, doc_id, at) of the marked suffixes; ``flags``: the broadcast bitmap."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = _ids(batch.column("doc_id"))
            for lo, _, data, offs in tokens.blocks(batch.column("text")):
                row, at, key, ctx, _, _ = marked(tokens.Words(data, offs), flags.value, shift)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(ids[lo + row]), pa.array(at)], names=["key", "ctx", "doc_id", "at"])

    return docs.mapInArrow(run, "key long, ctx long, doc_id long, at int")


_CONTEXT = "key long, ctx long, first long, last long, span int, around binary"


def contexts(docs: DataFrame, flags, shift: int, often, hot: bool) -> DataFrame:
    """The contexts of marked suffixes, with the smallest and the largest document, each once for a flush of a task.

    ``often``: the broadcast sorted hot keys; ``hot``: whether theirs are wanted or all others.
    """
    import pyarrow as pa

    def emit(parts):
        doc, key, ctx, span, near = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, ctx))
        start = _starts(ctx[order])
        one, last = order[start], order[np.append(start[1:], len(order)) - 1]
        columns = [pa.array(x) for x in (key[one].view(np.int64), ctx[one].view(np.int64), doc[one], doc[last], span[one])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in near[one]], pa.binary())], names=["key", "ctx", "first", "last", "span", "around"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids = _ids(batch.column("doc_id"))
            for lo, _, data, offs in tokens.blocks(batch.column("text")):
                row, _, key, ctx, span, near = marked(tokens.Words(data, offs), flags.value, shift)
                pick = np.isin(key, often.value) == hot
                if pick.any():
                    parts.append((ids[lo + row[pick]], key[pick], ctx[pick], span[pick], near[pick]))
                    held += int(pick.sum())
                if held >= CONTEXTS:
                    yield emit(parts)
                    parts, held = [], 0
        if held:
            yield emit(parts)

    return docs.mapInArrow(run, _CONTEXT)


_FOUND = "ctx long, lo int, hi int, first long, last long"


def _read(table) -> tuple[np.ndarray, ...]:
    """key, ctx, first, last, the ends of the span, and the words around of contexts; equal ones become one."""
    key, ctx, first, last = (table.column(c).to_numpy() for c in ("key", "ctx", "first", "last"))
    order = np.argsort(ctx, kind="stable")
    start = _starts(ctx[order])
    one = order[start]
    if len(one):
        first, last = np.minimum.reduceat(first[order], start), np.maximum.reduceat(last[order], start)
    span = table.column("span").to_numpy().astype(np.int64)[one]
    near = np.frombuffer(b"".join(table.column("around").take(one).to_pylist()), ">u4").reshape(len(one), 2 * REACH)
    return key[one], ctx[one], first, last, span >> 5, span & 31, near


def _stretches(key: np.ndarray, near: np.ndarray):
    """A function of t and some contexts: hashes of the stretches that start t words before them."""
    with np.errstate(over="ignore"):
        sums = [np.zeros((len(key), REACH + 1), np.uint64) for _ in range(2)]
        for side in (0, 1):
            for k in range(REACH):
                sums[side][:, k + 1] = sums[side][:, k] + (near[:, side * REACH + k].astype(np.uint64) + np.uint64(1)) * tokens._STEP[side * REACH + k]
        whole = tokens.mix(key.view(np.uint64))

    def at(t: int, own: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return tokens.mix(sums[1][own, t] + sums[0][own, REACH - t] + whole[own])

    return at


def compare(table):
    """Of the contexts of one shard, what two documents or more share around them: from lo to hi, relative to their places."""
    import pyarrow as pa

    key, ctx, first, last, nearest, farthest, near = _read(table)
    left, right = farthest, REACH - nearest
    many = first != last
    lo, hi = np.where(many, -left, 0), np.where(many, GRAM + right, 0)
    least, most = first.copy(), last.copy()

    def note(i, start, end, a, z):
        lo[i], hi[i] = np.minimum(lo[i], start), np.maximum(hi[i], end)
        least[i], most[i] = np.minimum(least[i], a), np.maximum(most[i], z)

    # The suffix array: sorted by the first words, then word by word; neighbours are compared and extended to the left.
    whole = np.concatenate([key.astype(">i8").view(np.uint8).reshape(-1, 8), np.ascontiguousarray(near).view(np.uint8).reshape(len(key), -1)], 1)
    order = np.argsort(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), kind="stable")
    i, j = order[:-1], order[1:]
    a, z = np.minimum(first[i], first[j]), np.maximum(last[i], last[j])
    same = (key[i] == key[j]) & (a != z)
    i, j, a, z = i[same], j[same], a[same], z[same]
    equal = near[i] == near[j]
    run = lambda e, bound: np.minimum(np.where(e.all(1), REACH, np.argmin(e, 1)), bound)
    r = run(equal[:, :REACH], np.minimum(right[i], right[j]))
    l = run(equal[:, REACH:], np.minimum(left[i], left[j]))  # noqa: E741
    good = l + r >= REACH
    i, j, a, z, l, r = i[good], j[good], a[good], z[good], l[good], r[good]  # noqa: E741
    note(i, -l, GRAM + r, a, z)
    note(j, -l, GRAM + r, a, z)
    # Stretches that start t words before their minimiser, sorted.
    stretch = _stretches(key, near)
    for t in range(REACH + 1):
        own = np.flatnonzero((nearest <= t) & (t <= farthest))
        if not len(own):
            continue
        h = stretch(t, own)
        order = np.argsort(h, kind="stable")
        own, h = own[order], h[order]
        start = _starts(h)
        size = np.diff(np.append(start, len(own)))
        a, z = np.repeat(np.minimum.reduceat(first[own], start), size), np.repeat(np.maximum.reduceat(last[own], start), size)
        hit = a != z
        note(own[hit], np.full(hit.sum(), -t), np.full(hit.sum(), LEAST - t), a[hit], z[hit])
    got = np.flatnonzero(hi > lo)
    columns = (ctx, lo.astype(np.int32), hi.astype(np.int32), least, most)
    return pa.table({c.split()[0]: pa.array(x[got]) for c, x in zip(_FOUND.split(", "), columns, strict=True)})


def hot_stretches(hot: DataFrame) -> DataFrame:
    """The same for contexts of hot first words, from the hashes of their stretches."""
    import pyarrow as pa

    def unpack(batches):
        for batch in batches:
            key, ctx, first, last, nearest, farthest, near = _read(batch)
            stretch = _stretches(key, near)
            got = [(own, np.full(len(own), t, np.int8), stretch(t, own)) for t in range(REACH + 1) if len(own := np.flatnonzero((nearest <= t) & (t <= farthest)))]
            own, t, h = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (h.view(np.int64), ctx[own], t, first[own], last[own])]], names=["h", "ctx", "t", "first", "last"])

    each = hot.mapInArrow(unpack, "h long, ctx long, t byte, first long, last long")
    shared = each.groupBy("h").agg(F.min("first").alias("first"), F.max("last").alias("last")).where("first <> last")
    found = each.select("h", "ctx", "t").join(shared, "h").groupBy("ctx").agg(F.max("t").alias("t"), F.min("t").alias("u"), F.min("first").alias("first"), F.max("last").alias("last"))
    return found.select("ctx", F.expr("cast(-t as int)").alias("lo"), F.expr(f"cast({LEAST} - u as int)").alias("hi"), "first", "last")


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, start_word, end_word, n_words, other_doc of every maximal repeated passage.

    other_doc is the smallest document that has a part of LEAST words or more of the passage; for that one itself it is the largest.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scratch = Scratch(spark)
    bitmap, shift = repeated(docs, size)
    flags = spark.sparkContext.broadcast(bitmap)
    rows = scratch.save(suffixes(docs, flags, shift), "suffixes")
    # Contexts of each key: more than ``hot`` of them, or so many places that each task's share of them would crowd a shard.
    per_key = rows.groupBy("key", "ctx").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("contexts"), F.sum("n").alias("places"))
    per_key = scratch.save(per_key.where((F.col("contexts") > hot) | (F.col("places") > CROWD * hot)), "often")
    bound, keys = hot, per_key
    while keys.limit(HOT_KEYS + 1).count() > HOT_KEYS:
        bound *= 2
        keys = per_key.where((F.col("contexts") > bound) | (F.col("places") > CROWD * bound))
    often = np.sort(keys.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))
    shards = max(16, 1 << int(np.ceil(np.log2(max(1, rows.count() / PER_SHARD)))))
    shared = spark.sparkContext.broadcast(often)
    found = contexts(docs, flags, shift, shared, False).groupBy(F.pmod(F.shiftright("key", 1), F.lit(shards)).alias("shard")).applyInArrow(compare, _FOUND)
    if len(often):
        crowded = contexts(docs, flags, shift, shared, True).groupBy("key", "ctx").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("span").alias("span"), F.first("around").alias("around"))
        found = found.unionByName(hot_stretches(scratch.save(crowded, "crowded")))
    places = rows.select("ctx", "doc_id", "at").join(found, "ctx")
    places = scratch.save(places.select("doc_id", (F.col("at") + F.col("lo")).alias("from"), (F.col("at") + F.col("hi")).alias("to"), "first", "last"), "places")
    scratch.drop("suffixes", "often", "crowded")
    order = Window.partitionBy("doc_id").orderBy("from", "to")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    other = F.when(F.col("first") != F.col("doc_id"), F.col("first")).otherwise(F.col("last"))
    return (
        places.withColumn("new", F.when(reach >= F.col("from"), 0).otherwise(1))
        .withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "part")
        .agg(F.min("from").alias("start_word"), F.max("to").alias("end_word"), F.min("first").alias("first"), F.max("last").alias("last"))
        .select(
            F.when(F.col("doc_id") != F.lit(_NONE), F.col("doc_id")).alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
            F.when(other != F.lit(_NONE), other).alias("other_doc"),
        )
    )
