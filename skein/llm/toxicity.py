"""Toxicity by a linear-chain conditional random field over words.

Each word of a text is tagged toxic or not. A word's evidence is the sum of the
weights of its features (the word, its first 6 and its first 4 bytes, lower-cased)
and a bias; four transition weights link neighbours. Forward-backward gives every
word's marginal probability of being toxic. With two tags the messages are one
log-odds number for each word, so whole blocks of texts run together, word by word,
exactly, over any length.

Labelled tokens come from the labelled documents of the training folds (the
``MOST`` first of each label by a hash of doc_id): features that occur in toxic
documents significantly more often mark their words as toxic there, all other
words are marked clean. The field is fitted to these by gradient ascent of its
conditional likelihood. A logistic regression on the training documents turns the
marginals (their noisy-or, largest and logarithmic sum) into a document score with
the natural share of toxic documents restored.

The text alone is scored; null and empty texts get the score of no evidence. With
no training rows of both labels every score is the toxic share (0 without any).
Offsets of words with a marginal of ``TAG`` or more are given as (start, end) in
code points, ``spans``. Repeated rows get the same score each. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import samples, tokens
from skein.storage import ship_package

MOST = 1500  # documents of each label that are learnt from, at most
FIELD_DOCS = 400  # of each label that the field itself is fitted to
PREFIXES = (6, 4)
TAG = 0.5
CHAIN = 1 << 20  # bytes of the texts whose messages run together: a step for each word of the longest, so more texts at once cost less
THRESHOLD = 0.3


def features(words: tokens.Words) -> np.ndarray:
    """Hashes of each word's features, features by words."""
    out = [words.hash]
    for k in PREFIXES:
        end = np.minimum(words.start + k, words.end)
        out.append(tokens.mix(words.stretch(words.start, end) + np.uint64(k)))
    return np.stack(out)


def _chain(evidence: np.ndarray, bounds: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds messages; a: the transition weights, from tag by to tag."""
    count = np.diff(bounds)
    order = np.argsort(-count, kind="stable")
    count, first = count[order], bounds[:-1][order]
    alive = np.searchsorted(-count, -np.arange(count[0] if len(count) else 0), "left")  # texts with more than t words
    forward, backward = evidence.copy(), np.zeros_like(evidence)
    e = np.exp(a)
    # log((e^x a11 + a01) / (e^x a10 + a00)), with e^x cut so that it stays finite
    onward = lambda x: (lambda r: np.log((r * e[1, 1] + e[0, 1]) / (r * e[1, 0] + e[0, 0])))(np.exp(np.clip(x, -60, 60)))
    back = lambda x: (lambda r: np.log((r * e[1, 1] + e[1, 0]) / (r * e[0, 1] + e[0, 0])))(np.exp(np.clip(x, -60, 60)))
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        forward[at] += onward(forward[at - 1])
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        backward[at - 1] = back(evidence[at] + backward[at])
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Sorted feature hashes with weights, bias, transitions, and the document regression."""

    def __init__(self, texts: list[str], toxic: np.ndarray, share: float):
        import pyarrow as pa

        self.known, self.weight = np.zeros(0, np.uint64), np.zeros(0)
        self.bias, self.a = -6.0, np.zeros((2, 2))
        self.doc_mean, self.doc_scale, self.doc_weight = np.zeros(3), np.ones(3), np.zeros(3)
        self.doc_bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        if not toxic.any() or toxic.all():
            return
        parts, counts = [], []
        for _, _, data, offs in tokens.blocks(pa.array(texts, pa.large_string())):
            w = tokens.Words(data, offs, tokens.ALNUM)
            parts.append(features(w))
            counts.append(np.diff(w.bounds))
        feats, count = np.concatenate(parts, 1), np.concatenate(counts)
        bounds = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(count)), count)
        n1, n0 = int(toxic.sum()), int((~toxic).sum())
        known, marked = [], []
        for row in feats:
            names, inverse = np.unique(row, return_inverse=True)
            pair = np.unique(doc * len(names) + inverse)  # a document counts once
            d, f = pair // len(names), pair % len(names)
            c1, c0 = (np.bincount(f[toxic[d] == y], minlength=len(names)) for y in (True, False))
            odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
            error = np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
            del pair, d, f, inverse
            marked.append(names[(c1 >= 3) & (odds > 1) & (odds / error > 3)])
            known.append(names[(c1 + c0 >= 3) & (np.abs(odds) / error > 2)])
        self.known = np.unique(np.concatenate(known))
        tag = np.zeros(len(doc), bool)
        for row, names in zip(feats, marked, strict=True):
            tag |= np.isin(row, names)
        tag &= toxic[doc]
        self._fit_field(feats, bounds, tag, toxic)
        # The documents that the field was fitted to look cleaner than others; the rest decide the scores where there are enough.
        x = self._document(self.evidence(feats), bounds)
        self._fit_documents(x, toxic, share)

    def columns(self, feats: np.ndarray) -> np.ndarray:
        """Where each feature stands among the known ones; their number if it doesn't."""
        if not len(self.known):
            return np.zeros(feats.shape, np.int64)
        at = np.minimum(np.searchsorted(self.known, feats), len(self.known) - 1)
        return np.where(self.known[at] == feats, at, len(self.known))

    def evidence(self, feats: np.ndarray) -> np.ndarray:
        return np.append(self.weight, 0.0)[self.columns(feats)].sum(0) + self.bias

    def _fit_field(self, feats: np.ndarray, bounds: np.ndarray, tag: np.ndarray, toxic: np.ndarray) -> None:
        docs = np.concatenate([np.flatnonzero(toxic == y)[:FIELD_DOCS] for y in (True, False)])
        pick = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs] or [np.zeros(0, int)])
        own = np.concatenate([[0], np.cumsum(np.diff(bounds)[docs])])
        column, y, size = self.columns(feats[:, pick]), tag[pick].astype(float), len(self.known) + 1
        last = np.zeros(len(y), bool)
        last[own[1:][np.diff(own) > 0] - 1] = True
        link = np.flatnonzero(~last)  # words with a word after them
        theta = np.concatenate([np.zeros(size - 1), [self.bias], np.zeros(4)])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        seen = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                seen[i, j] = ((y[link] == i) & (y[link + 1] == j)).sum()
        for step in range(1, 61):
            weight, bias, a = np.append(theta[: size - 1], 0.0), theta[size - 1], theta[size:].reshape(2, 2)
            e = weight[column].sum(0) + bias
            f, b = _chain(e, own, a)
            p = _sigmoid(f + b)
            g = np.zeros_like(theta)
            for row in column:
                g[: size - 1] += np.bincount(row, y - p, size)[: size - 1]
            g[size - 1] = (y - p).sum()
            right = e[link + 1] + b[link + 1]
            score = np.stack([a[i, j] + i * f[link] + j * right for i in (0, 1) for j in (0, 1)])
            score = np.exp(score - score.max(0))
            g[size:] = seen.ravel() - (score / score.sum(0)).sum(1)
            g = g / max(y.sum(), 1) - 1e-3 * np.append(theta[:-5], np.zeros(5))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weight, self.bias, self.a = theta[: size - 1], float(theta[size - 1]), theta[size:].reshape(2, 2)

    def _document(self, evidence: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        p = self.marginals(evidence, bounds)
        return pooled(p, bounds)

    def marginals(self, evidence: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        f, b = _chain(evidence, bounds, self.a)
        return _sigmoid(f + b)

    def _fit_documents(self, x: np.ndarray, toxic: np.ndarray, share: float) -> None:
        self.doc_mean, self.doc_scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.doc_mean) / self.doc_scale, np.ones(len(x))])
        weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
        beta = np.zeros(4)
        for _ in range(30):  # Newton's method
            q = _sigmoid(z @ beta)
            h = z.T @ (z * (weight * q * (1 - q))[:, None]) + 1e-2 * np.eye(4)
            beta += np.linalg.solve(h, z.T @ (weight * (toxic - q)) - 1e-2 * beta)
        self.doc_weight, self.doc_bias = beta[:3], float(beta[3])

    def score(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _sigmoid((pooled(p, bounds) - self.doc_mean) / self.doc_scale @ self.doc_weight + self.doc_bias)


def pooled(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text: noisy-or, largest, and logarithm of one more than the sum of its words' marginals."""
    count = np.diff(bounds)
    out, some = np.zeros((len(count), 3)), count > 0
    if some.any():
        first = bounds[:-1][some]
        out[some, 0] = 1 - np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), first))
        out[some, 1] = np.maximum.reduceat(p, first)
        out[some, 2] = np.log1p(np.add.reduceat(p, first))
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = MOST, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the labelled rows outside the held-out fold."""
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).alias("toxic")).where((samples.fold(F.col("doc_id")) != 2) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    share = known.agg(F.avg(F.col("toxic").cast("double")).alias("s")).first()["s"] or 0.0
    chosen = samples.per_class(known.dropDuplicates(["doc_id"]), "toxic", most)
    got = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "toxic").toPandas()
    return Model([t or "" for t in got["text"]], got["toxic"].to_numpy() == 1, share)


def tag(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_toxic_words and spans (start and end in code points of the words tagged) of every row."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, hits, spans = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for lo, hi, data, offs in tokens.blocks(batch.column("__text"), CHAIN):
                w = tokens.Words(data, offs, tokens.ALNUM)
                p = model.marginals(model.evidence(features(w)), w.bounds)
                scores[lo:hi] = model.score(p, w.bounds)
                found = np.flatnonzero(p >= TAG)
                if not len(found):
                    continue
                row = np.searchsorted(w.bounds, found, "right") - 1
                hits[lo:hi] = np.bincount(row, minlength=hi - lo)
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                base = point[offs[row]]
                for r, s, e in zip(row, point[w.start[found]] - base, point[w.end[found]] - base, strict=True):
                    spans[lo + r].append({"start": int(s), "end": int(e)})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(hits), pa.array(spans, kind)], names=["doc_id", "score", "n_toxic_words", "spans"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_toxic_words long, spans array<struct<start:int,end:int>>")
