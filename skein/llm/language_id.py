"""Language identification with string kernels.

A text is a sequence of bytes, lower-cased (A-Z), everything ASCII that isn't a
letter made a space. The kernel of two texts is the blended spectrum of their
n-grams of 1, 2 and 3 bytes, by presence: for each n the number of n-grams that
both have over the root of the product of how many each has, averaged over n; the
n-grams that count are those of the landmarks. Landmarks are training texts, the
same number for each language. The Nyström map sends a text to its kernel values
with the landmarks times the inverse root of the landmarks' own kernel matrix, and
one-versus-rest kernel ridge regression is solved there in closed form. Scoring is
batched: presence matrix times landmark matrix times weights.

Training takes ``PER_CLASS`` texts of each language at most, by a hash of doc_id,
from the rows outside the held-out fold (bounded, so it fits the driver); every
row is scored, over its whole text. The score is (1 + decision value) / 2 of the
best language, cut to [0, 1]; under 0.5 no language claims the text.

Texts that are null, empty or without a letter are ``und`` with score 0. Without
any training row every text is ``und``. Ties go to the language first by code
point. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import samples, tokens
from skein.storage import ship_package

NGRAMS = (1, 2, 3)
PER_CLASS = 400
LANDMARKS = 24  # of each language
RIDGE = 1e-2
UND = "und"

#: Folded bytes as numbers without gaps, so that tables by n-gram are small: 0 a space, then letters, then bytes beyond ASCII.
FOLD = np.zeros(256, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(1, 27)
FOLD[128:] = np.arange(27, 155)
SYMBOLS = 155
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """The n-gram from each folded byte on, as a number; n - 1 fewer than bytes."""
    out = data.astype(np.int32)
    for _ in range(n - 1):
        out = out[:-1] * SYMBOLS + data[len(data) - len(out) + 1 :]
    return out


class Spectrum:
    """The n-grams that count: for each n, their codes and a table from code to column."""

    def __init__(self, known: list[np.ndarray]):
        self.known = known
        self.table = []
        for n, k in zip(NGRAMS, known, strict=True):
            t = np.full(SYMBOLS**n, -1, np.int32)
            t[k] = np.arange(len(k))
            self.table.append(t)

    def presence(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """For each n a matrix of rows by n-grams, 1 where present, each row over the root of its sum."""
        data, rows = FOLD[data], len(offs) - 1
        size, out = np.diff(offs), []
        row = np.repeat(np.arange(rows, dtype=np.int64), size)
        left = np.repeat(offs[1:], size) - np.arange(len(data))  # bytes to the end of the text
        for n, table in zip(NGRAMS, self.table, strict=True):
            columns = len(self.known[n - 1])
            p = np.zeros((rows, columns), np.float32)
            if len(data) >= n:
                m = len(data) - n + 1
                column = table[codes(data, n)]
                good = (column >= 0) & (left[:m] >= n)
                p.ravel()[row[:m][good] * columns + column[good]] = 1
            norm = np.sqrt(p.sum(1, keepdims=True))
            out.append(p / np.maximum(norm, 1))
        return out


class Model:
    """Landmarks, their n-grams and the weights of the languages."""

    def __init__(self, texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS):
        self.languages = sorted(set(labels))
        chosen: list[int] = []
        for lang in self.languages:
            own = [i for i, x in enumerate(labels) if x == lang]
            chosen += [own[int(j)] for j in np.linspace(0, len(own) - 1, min(landmarks, len(own)))]
        data, offs = _join([texts[i] for i in chosen])
        known = []
        for n in NGRAMS:
            inside = np.concatenate([codes(FOLD[data[a:b]], n) for a, b in zip(offs[:-1], offs[1:], strict=True) if b - a >= n] or [np.zeros(0, np.int32)])
            known.append(np.unique(inside))
        self.known = known
        spectrum = Spectrum(known)
        self.marks = [p.T.copy() for p in spectrum.presence(data, offs)]
        kernel = self._kernel(spectrum, data, offs).astype(np.float64)
        value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        phi = np.concatenate([self._kernel(spectrum, *_join(texts[i : i + 256])) for i in range(0, len(texts), 256)]) @ root
        phi = np.concatenate([phi, np.ones((len(phi), 1))], 1)
        target = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        # Each language weighs the same, whatever its number of rows.
        weight = np.array([1 / labels.count(x) for x in self.languages])[[self.languages.index(x) for x in labels]]
        weight *= len(labels) / weight.sum()
        left = phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1])
        beta = np.linalg.solve(left, phi.T @ (target * weight[:, None]))
        self.weights, self.bias = root @ beta[:-1], beta[-1]

    def _kernel(self, spectrum: Spectrum, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return sum(p @ m for p, m in zip(spectrum.presence(data, offs), self.marks, strict=True)) / len(NGRAMS)

    def decide(self, spectrum: Spectrum, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Decision values, rows by languages."""
        return self._kernel(spectrum, data, offs) @ self.weights + self.bias


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each row whether it has a letter of any script."""
    count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offs])
    out = count(ASCII_LETTER[data]) > 0
    for i in np.flatnonzero(~out & (count(data >= 128) > 0)):
        out[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def train(docs: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model from the rows outside the held-out fold; None without any."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where((samples.fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = samples.per_class(rows.select("doc_id", "lang"), "lang", per_class)
    got = rows.join(F.broadcast(chosen.dropDuplicates()), ["doc_id", "lang"]).orderBy("lang", "doc_id", "text").select("lang", "text").toPandas()
    texts = [t.encode() for t in got["text"]]
    fine = [bool(t) and bool(has_letter(*_join([t]))[0]) for t in texts]
    texts, labels = [t for t, ok in zip(texts, fine, strict=True) if ok], [x for x, ok in zip(got["lang"], fine, strict=True) if ok]
    return Model(texts, labels) if texts else None


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns ``keep``), lang_pred and score of every row."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = [c for c in keep or [key] if c not in ("lang_pred", "score", "__text")]
    source = text if text in columns else "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        spectrum = Spectrum(model.known) if model else None
        for batch in batches:
            names, scores = np.full(batch.num_rows, UND, object), np.zeros(batch.num_rows)
            if model:
                for lo, hi, data, offs in tokens.blocks(batch.column(source)):
                    for a in range(0, hi - lo, 256):
                        part = offs[a : min(a + 256, hi - lo) + 1]
                        own, part = data[part[0] : part[-1]], part - part[0]
                        value = model.decide(spectrum, own, part)
                        best = value.argmax(1)
                        ok = has_letter(own, part)
                        at = slice(lo + a, lo + a + len(best))
                        names[at] = np.where(ok, np.array(model.languages, object)[best], UND)
                        scores[at] = np.where(ok, np.clip((1 + value[np.arange(len(best)), best]) / 2, 0, 1), 0.0)
            out = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*out, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    rows = docs.select(*columns) if source == text else docs.select(*columns, F.col(text).alias("__text"))
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {types[c].simpleString()}" for c in columns] + ["lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)
