"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its UTF-8 bytes and an end mark (0xFF, which no text holds), each eight
bits, most significant first. For each bit ``len(CONTEXTS)`` predictors look up how
often it was 0 and 1 after the last three and five bytes and after the
beginning of the current word, in tables of 2**``bits`` slots (``BITS``); a context, and for the second
half of a byte its first, are hashed to 16 slots, one for each beginning of the half to come. Their
log-odds are combined by weights that are chosen by the bit's place in its byte and
how often the two longest contexts were seen (the gates), and the sum is the
log-odds of the bit. Within a text, the share of each predictor is refined online:
after every ``CHUNK`` bytes it takes a step along the gradient of the coding cost
(AdaGrad), beginning anew with each text. So a text's score depends on the trained
model and the text alone. The probabilities of all texts add up to 1 at most.

Training takes all documents outside the held-out tenth:

1. Every task adds up the counts of its share of the texts in whole tables, and sends
   their slots that aren't 0; tables are added up segment by segment. What reaches
   the driver, and is broadcast, are tables of two bytes a slot, whatever the input.
2. The weights of the gates are fitted by Newton's method to all training documents. A
   text that is counted in a table looks too well known there, so the documents are split
   into two halves by a hash of id and text, and each half is predicted from the counts of
   the other. What the fit needs are the numbers of bits by gate and by the log-odds of
   each predictor, on ``LEVELS`` of them: a table of a fixed size, which tasks add up.
   The scores use the counts of both halves, and their log-odds as they are.

Beside the model stands the smoothed word unigram (``base_score``). Words of a
``HOT``-th of all tokens or more, at most that many, are broadcast; all others are
joined with their counts by a shuffle, as rows of document, word and occurrences.

Null and empty texts are their end mark (and end token) alone. A null id is held
out. Repeated rows are counted as often as they stand there, and each gets its
result. Without training documents every bit costs one bit. Texts are worked through in
pieces of ``BLOCK`` bytes, so a very long one needs no more memory for the model. Words, and
contexts of words, are known by 64-bit hashes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import tokens
from skein.storage import Scratch, ship_package

CONTEXTS = ("three bytes", "five bytes", "word so far")
BITS = (20, 22, 22)  # of the slots of each context
SEGMENT = 16  # bits of the slots that are added up together
LEAD = 40  # bytes before a piece that its contexts may reach
WORD = 32  # bytes of a word that its context holds, the last ones
BLOCK = 1 << 17  # a multiple of CHUNK, so that pieces end where chunks do
CHUNK = 512
SLICE, GROUP = 1 << 14, 1 << 13  # symbols that are looked up, and mixed, at once
SORTED = 1 << 23  # bytes of texts that are put in order of their length at once
STEP = 0.08
CALIBRATION = 8  # Newton's steps
#: Of log-odds for what they favour, 0 to 7; those against it are as many again. Each stands for all that are nearest to it.
LEVELS = np.array([0, 0.5, 1.1, 1.9, 3, 4.5, 6.5, 9.5])
HOT = 20_000
SCALE = 512  # log-odds of 1 in the tables
SEEN = (0, 3, 20)  # what a slot was seen more often than, by its confidence from 1 on
_SALTS = [np.uint32(0x9E3779B1 * (2 * i + 1) & 0xFFFFFFFF) for i in range(len(CONTEXTS))]
END = 255


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(10)) == 0


@dataclass
class Piece:
    """Symbols to be predicted: their context hashes (contexts by symbols), and on demand their row and their place in the text."""

    symbol: np.ndarray
    context: np.ndarray
    offs: np.ndarray  # of the texts, in symbols, those of ``skip`` too
    first_row: int
    skip: int
    done: int

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.first_row, self.first_row + len(self.offs) - 1), np.diff(self.offs))[self.skip :]

    @property
    def place(self) -> np.ndarray:
        before = self.offs[:-1].copy()
        before[:1] -= self.done
        return (np.arange(self.offs[-1]) - np.repeat(before, np.diff(self.offs)))[self.skip :]


def _piece(data: np.ndarray, offs: np.ndarray, first_row: int, skip: int, done: int, ends: bool) -> Piece:
    """Of the texts between ``offs``; the first ``skip`` bytes are context alone, ``done`` bytes of the first text came before ``data``."""
    n_rows = len(offs) - 1
    if ends:  # an end mark after each text
        offs = offs + np.arange(n_rows + 1)
        symbol, text = np.full(len(data) + n_rows, END, np.uint8), np.ones(len(data) + n_rows, bool)
        text[offs[1:] - 1] = False
        symbol[text] = data
    else:
        symbol = data
    n = len(symbol)
    wide, past = symbol.astype(np.uint32), np.zeros((3, n), np.uint32)  # the last three bytes, the one before, and the one before that
    past[0, 1:] = wide[: max(n - 1, 0)]
    for k in (2, 3):
        past[0, k:] |= wide[: max(n - k, 0)] << np.uint32(8 * k - 8)
    for k in (4, 5):
        past[k - 3, k:] = wide[: max(n - k, 0)]
    for k in range(5):  # what lies before a text
        begin = offs[:-1] + k
        begin = begin[begin < offs[1:]]
        past[0, begin] &= np.uint32((1 << 8 * min(k, 3)) - 1)
        past[1, begin] = 0 if k < 4 else past[1, begin]
        past[2, begin] = 0
    context = np.empty((len(CONTEXTS), n), np.uint32)
    with np.errstate(over="ignore"):
        context[0] = past[0]
        past[1] <<= np.uint32(24)
        past[1] |= past[0]
        past[1] *= np.uint32(0x2C1B3C6D)
        past[2] += np.uint32(1)
        past[2] *= np.uint32(0x297A2D39)
        np.bitwise_xor(past[1], past[2], out=context[1])
        context[2] = tokens.Words(symbol, offs, tokens.ALNUM).so_far(WORD, np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
        for h, salt in zip(context, _SALTS, strict=True):
            h += salt
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
    return Piece(symbol[skip:], context[:, skip:], offs, first_row, skip, done)


def pieces(texts) -> Iterator[Piece]:
    """All symbols of a pyarrow string array, in pieces of about ``BLOCK`` bytes."""
    for lo, hi, data, offs in tokens.blocks(texts, BLOCK):
        if hi - lo > 1 or len(data) <= 2 * BLOCK:
            yield _piece(data, offs, lo, 0, 0, True)
            continue
        for a in range(0, len(data), BLOCK):
            b, skip = min(a + BLOCK, len(data)), min(a, LEAD)
            part = data[a - skip : b]
            yield _piece(part, np.array([0, len(part)]), lo, skip, a - skip, b == len(data))


_SYMBOL = np.arange(256)[:, None]
_J = np.arange(8)[None]
_NIBBLE = np.where(_J < 4, _SYMBOL >> 4, _SYMBOL & 15)
#: Of each symbol and each of its bits: the place among the 16 slots, and 1 or -1.
_NODE, _SIGN = _NIBBLE >> 4 - _J % 4 | 1 << _J % 4, ((_NIBBLE >> 3 - _J % 4 & 1) * 2 - 1).astype(np.float32)


_PLACE = [np.uint32(k) for k in (0x9E3779B1, 0x27D4EB2F, 13, 0x165667B1, 4)]


def places(symbol: np.ndarray, context: np.ndarray, bits: tuple[int, ...]) -> Iterator[np.ndarray]:
    """By context, the slots of the two halves of each symbol: each is one of 16 that begin at one place in memory."""
    spread, first, shift, last, four = _PLACE
    half = np.stack([symbol >> 4, symbol & 15]).astype(np.uint32)
    with np.errstate(over="ignore"):
        second = (half[0] + 1) * spread
        for own, b in zip(context, bits, strict=True):
            h = np.stack([own, own ^ second])
            h *= first
            h ^= h >> shift
            h *= last
            h >>= np.uint32(36 - b)
            h <<= four
            h |= half
            out = np.empty((len(own), 2), np.int64)
            out[:, 0], out[:, 1] = h
            yield out


def empty_counts(bits: tuple[int, ...]) -> list[np.ndarray]:
    """For each context room for the counts of the 16 halves of a byte after all it is hashed to (a task counts fewer than 2**32 symbols)."""
    return [np.zeros(1 << b, np.uint32) for b in bits]


def count_halves(texts, bits: tuple[int, ...], into: list[np.ndarray]) -> None:
    """Adds the halves of the bytes of texts to ``into``; the counts of their bits follow from them."""
    for piece in pieces(texts):
        for counts, at in zip(into, places(piece.symbol, piece.context, bits), strict=True):
            np.add.at(counts, at.ravel(), np.uint32(1))


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Two bytes a slot from counts of halves of bytes: log-odds of the next bit, and in the last two bits how sure they are."""
    n = np.zeros((len(counts) >> 4, 32), np.int64)  # by beginning: 1, then each bit behind
    n[:, 16:] = counts.reshape(-1, 16)
    for node in range(15, 0, -1):
        n[:, node] = n[:, 2 * node] + n[:, 2 * node + 1]
    out = np.zeros((len(n), 16), np.int16)
    for node in range(1, 16):
        odds = np.round(np.clip(np.log((n[:, 2 * node + 1] + 0.4) / (n[:, 2 * node] + 0.4)), -15, 15) * SCALE).astype(np.int16)
        out[:, node] = odds << 2 | np.searchsorted(SEEN, n[:, node], "left").astype(np.int16)
    return out.ravel()


_HALF = np.arange(16)


def along(table: np.ndarray, turned, kind) -> np.ndarray:
    """For each half of a byte after each context its four slots of ``table`` as one number, so that one look finds them.

    ``turned`` (slots, sign) makes ``kind`` of the slots of a bit, for the bit that came: the sign is 1 or -1 by half.
    """
    table = table.reshape(-1, 16)
    out = np.empty((len(table), 16, 4), kind)
    for lo in range(0, len(table), 1 << 14):
        for j in range(4):
            out[lo : lo + (1 << 14), :, j] = turned(table[lo : lo + (1 << 14), 16 + _HALF >> 4 - j], ((_HALF >> 3 - j & 1) * 2 - 1).astype(table.dtype))
    return out.reshape(-1).view(f"u{4 * out.itemsize}")


def found(paths: list[np.ndarray], bits: tuple[int, ...], symbol: np.ndarray, context: np.ndarray) -> Iterator[np.ndarray]:
    """What ``paths`` hold for the two halves of each symbol, context by context."""
    for path, at in zip(paths, places(symbol, context, bits), strict=True):
        yield path.take(at, mode="clip")


def levels(odds: np.ndarray) -> np.ndarray:
    """A byte for each slot of ``log_odds``: the level of the log-odds, 7 being none, and above it how sure they are."""
    size = np.searchsorted((LEVELS[1:] + LEVELS[:-1]) / 2 * SCALE, np.abs(odds >> 2)).astype(np.int8)
    return (np.where(odds < 0, 7 - size, 7 + size) | (odds & 3) << 4).astype(np.int8)


def count_levels(texts, paths: list[np.ndarray], bits: tuple[int, ...], into: np.ndarray) -> None:
    """Adds the bits of texts to ``into`` (bits of a byte by keys of ``fit_levels``)."""
    for piece in pieces(texts):
        three, five, word = (p.view(np.uint8) for p in found(paths, bits, piece.symbol, piece.context))
        key = five.astype(np.uint16)
        key <<= np.uint16(6)
        key |= word
        key <<= np.uint16(4)
        key |= three & np.uint8(15)  # the level alone of the shortest context
        key = key.reshape(-1, 8)
        for j in range(8):
            into[j] += np.bincount(key[:, j], minlength=1 << 16)


class Model:
    """Tables of log-odds, one for each context, and the weights of the gates."""

    def __init__(self, tables: list[np.ndarray], bits: tuple[int, ...]):
        self.tables, self.bits = tables, bits
        self.weight = np.full((8 * 16, len(CONTEXTS)), 0.3, np.float32)
        self._paths = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_paths": None}  # tasks make them of the tables, which are smaller

    def looked(self, symbol: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The gate of each bit, and by context the log-odds of the bit that came, in ``SCALE``."""
        if self._paths is None:
            self._paths = [along(t, lambda got, sign: (got >> 2) * sign << 2 | got & 3, np.int16) for t in self.tables]
        gate, odds = np.tile((_J[0] * 16).astype(np.int16), len(symbol)), []
        for c, got in enumerate(found(self._paths, self.bits, symbol, context)):
            got = got.view(np.int16).ravel()
            if c >= len(CONTEXTS) - 2:
                gate += (got & np.int16(3)) << np.int16(2 * (len(CONTEXTS) - 1 - c))
            got >>= np.int16(2)
            odds.append(got)
        return gate.astype(np.intp), odds

    def inputs(self, symbol: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log-odds of the predictors: contexts, symbols, bits; the gate of each bit; the bits as 1 and -1)."""
        n, sign = len(symbol), _SIGN.take(symbol, 0)
        gate, odds = self.looked(symbol, context)
        return np.stack(odds).reshape(-1, n, 8) * (sign / np.float32(SCALE)), gate.reshape(n, 8), sign

    def fit(self, texts) -> None:
        """The weights of the gates from texts, by the model's own tables."""
        paths, into = level_paths([levels(t) for t in self.tables]), np.zeros((8, 1 << 16), np.int64)
        count_levels(texts, paths, self.bits, into)
        self.fit_levels(into)

    def fit_levels(self, counts: np.ndarray, steps: int = CALIBRATION) -> None:
        """The weights of the gates by Newton's method, with a pull towards where they began.

        ``counts`` of bits by their place in the byte and a key: how sure the second context is, its level, the same of the
        third, the level of the first; of levels for the bit that came.
        """
        value = np.concatenate([-LEVELS[:0:-1], LEVELS, [0.0]])
        by = counts.reshape(8, 4, 16, 4, 16, 16).transpose(0, 1, 3, 5, 2, 4).reshape(len(self.weight), -1)  # gate by levels of all contexts
        every = np.stack([v.ravel() for v in np.meshgrid(value, value, value, indexing="ij")])
        for g in range(len(self.weight)):
            some = np.flatnonzero(by[g])
            own, n = every[:, some], by[g][some].astype(np.float64)
            start = self.weight[g].astype(np.float64)
            weight = start.copy()
            for _ in range(steps):
                p = 1 / (1 + np.exp(np.clip(weight @ own, -40, 40)))
                slope = own @ (n * p) - 2.0 * (weight - start)
                curve = (own * (n * p * (1 - p))) @ own.T + 2.0 * np.eye(len(weight))
                weight += np.clip(np.linalg.solve(curve, slope), -1, 1)
            self.weight[g] = weight

    def cost(self, texts, rows: int, step: float = STEP) -> tuple[np.ndarray, np.ndarray]:
        """(bits, symbols) that the texts cost and have."""
        bits, symbols = np.zeros(rows), np.zeros(rows, np.int64)
        for lo, hi, _, offs in tokens.blocks(texts, SORTED):
            part, order = texts.slice(lo, hi - lo), np.argsort(np.diff(offs), kind="stable")
            # Texts of a length have as many turns, so that those of a piece are mixed in few groups.
            bits[lo + order], symbols[lo + order] = self._cost(part.take(order) if hi - lo > 1 else part, hi - lo, step)
        return bits, symbols

    def _cost(self, texts, rows: int, step: float) -> tuple[np.ndarray, np.ndarray]:
        bits, symbols = np.zeros(rows), np.zeros(rows, np.int64)
        weights = np.ascontiguousarray(self.weight.T) / np.float32(-SCALE)  # for the log-odds of the other bit
        share, seen = np.ones((len(CONTEXTS), rows), np.float32), np.full((len(CONTEXTS), rows), 1e-3, np.float32)
        most, one, step, held = np.float32(40), np.float32(1), np.float32(step), np.empty((len(CONTEXTS), 0), np.float32)
        for piece in pieces(texts):
            n = len(piece.symbol)
            if not n:
                continue
            place, row = piece.place, piece.row
            symbols += np.bincount(row, minlength=rows)
            turn = ((place - place.min() // CHUNK * CHUNK) // CHUNK).astype(np.uint16)  # a piece has few turns
            order = np.argsort(turn, kind="stable")
            symbol, context, row, turn = piece.symbol.take(order), piece.context.take(order, 1), row.take(order), turn.take(order)
            if held.shape[1] < 8 * n:
                held = np.empty((len(CONTEXTS), 8 * n), np.float32)
            x = held[:, : 8 * n]
            for lo in range(0, n, SLICE):
                gate, odds = self.looked(symbol[lo : lo + SLICE], context[:, lo : lo + SLICE])
                for c, weight in enumerate(weights):
                    np.multiply(odds[c], weight.take(gate, mode="clip"), out=x[c, lo * 8 : (lo + SLICE) * 8])
            new = np.concatenate([[True], turn[1:] != turn[:-1]])
            begin = new.copy()
            begin[1:] |= row[1:] != row[:-1]
            first = np.flatnonzero(begin)
            group = new[first] | np.concatenate([[True], np.diff(first // GROUP) != 0])  # texts of one turn that fit the cache
            size, edges, at = np.diff(first, append=n) * 8, np.append(first[group], n), np.append(np.flatnonzero(group), len(first))
            for lo, hi, a, b in zip(edges[:-1] * 8, edges[1:] * 8, at[:-1], at[1:], strict=True):
                which, own, part = row[first[a:b]], first[a:b] * 8 - lo, x[:, lo:hi]
                shares = share[:, which]
                if (shares == 1).all():
                    z = part[0] + part[1]
                    spare = np.empty_like(z)
                    for p in part[2:]:
                        z += p
                else:
                    z, spare = part[0] * np.repeat(shares[0], size[a:b]), None
                    for p, own_share in zip(part[1:], shares[1:], strict=True):
                        spare = np.repeat(own_share, size[a:b])
                        spare *= p
                        z += spare
                if z.max() > most:
                    np.minimum(z, most, out=z)
                away = np.exp(z, out=z)
                sure = np.add(away, one, out=spare)
                error = np.divide(away, sure, out=away)
                pairs = sure[0::2] * sure[1::2]
                bits[which] += np.add.reduceat(np.log(pairs, out=pairs), own >> 1) / np.log(2)
                slope = np.stack([np.add.reduceat(np.multiply(error, p, out=sure), own) for p in part])
                steps = seen[:, which] + slope * slope
                seen[:, which] = steps
                share[:, which] = shares - step * slope / np.sqrt(steps)
        return bits, symbols


def level_paths(tables: list[np.ndarray]) -> list[np.ndarray]:
    """What ``count_levels`` looks into, of tables of ``levels``."""
    return [along(t, lambda got, sign: ((got & 15) - 7) * sign + 7 | got & 48, np.uint8) for t in tables]


class Halves:
    """Levels of the two halves of the training documents, made ready in each Python worker once."""

    def __init__(self, tables: list[list[np.ndarray]], bits: tuple[int, ...]):
        self.tables, self.bits, self._paths = tables, bits, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_paths": None}

    def count(self, texts, half: int, into: np.ndarray) -> None:
        """Adds texts of one half, by what is known from the other."""
        if self._paths is None:
            self._paths = [level_paths(t) for t in self.tables]
        count_levels(texts, self._paths[1 - half], self.bits, into)


def _by_half(batch) -> Iterator[tuple[int, object]]:
    import pyarrow as pa

    half = batch.column("__half").to_numpy()
    for h in (0, 1):
        texts = batch.column("__text").filter(pa.array(half == h))
        if len(texts):
            yield h, texts


def _tables(docs: DataFrame, bits: tuple[int, ...]) -> tuple[list[np.ndarray], Halves]:
    """Log-odds of all contexts, from the texts of all documents, and their levels in each half of them."""
    import pyarrow as pa

    spark, size = docs.sparkSession, 1 << SEGMENT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for half, texts in _by_half(b):
                if half not in own:
                    own[half] = empty_counts(bits)
                count_halves(texts, bits, own[half])
        for half, c, part in ((h, c, p) for h in own for c in range(len(bits)) for p in range(-(-len(own[h][c]) // size))):
            counts = own[half][c][part * size : (part + 1) * size]
            at = np.flatnonzero(counts)
            if len(at):
                gaps = np.diff(at, prepend=0).astype(np.uint32)
                numbers = [pa.array([v], pa.int32()) for v in (c, part, half)]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array([gaps.tobytes()]), pa.array([counts[at].tobytes()])], names=["context", "part", "half", "gaps", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for c, part, half, gaps, n in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if (c, part) not in sums:
                    sums[c, part] = np.zeros((2, min(size, 1 << bits[c])), np.int64)
                sums[c, part][half][np.cumsum(np.frombuffer(gaps, np.uint32), dtype=np.int64)] += np.frombuffer(n, np.uint32)
        for (c, part), halves in sums.items():
            out = [log_odds(halves.sum(0)), *[levels(log_odds(h)) for h in halves]]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part], pa.int32()), *[pa.array([t.tobytes()]) for t in out]], names=["context", "part", "odds", "one", "two"])

    counts = _few(docs).mapInArrow(count, "context int, part int, half int, gaps binary, n binary")
    out, halves = [np.zeros(1 << b, np.int16) for b in bits], [[np.full(1 << b, 7, np.int8) for b in bits] for _ in range(2)]
    for r in counts.repartition("context", "part").mapInArrow(add, "context int, part int, odds binary, one binary, two binary").toLocalIterator():
        c, part = r["context"], slice(r["part"] * size, (r["part"] + 1) * size)
        out[c][part], halves[0][c][part], halves[1][c][part] = np.frombuffer(r["odds"], np.int16), np.frombuffer(r["one"], np.int8), np.frombuffer(r["two"], np.int8)
    return out, Halves(halves, bits)


def _few(docs: DataFrame) -> DataFrame:
    """In tasks of up to a GB, as each sends a table."""
    stats = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.coalesce(min(1 << 20, max(2 * docs.sparkSession.sparkContext.defaultParallelism, stats >> 30)))


def _levels(docs: DataFrame, halves: Halves) -> np.ndarray:
    """The bits of all documents for ``Model.fit_levels``, each half by the counts of the other."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = np.zeros((8, 1 << 16), np.int64)
        for b in batches:
            for half, texts in _by_half(b):
                shared.value.count(texts, half, into)
        flat = into.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["cell", "n"])

    got = _few(docs).mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 8 << 16 rows at most
    shared.destroy()
    out = np.zeros(8 << 16, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(8, -1)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: tuple[int, ...] = BITS, calibration: int = CALIBRATION) -> Model:
    """A model of the texts of all documents outside the held-out tenth; ``calibration``: Newton's steps for the gates."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), F.pmod(F.xxhash64(key, text), F.lit(2)).cast("int").alias("__half"), held_out(F.col(key)).alias("__out")).where("NOT __out").drop("__out")
    tables, halves = _tables(rows, bits)
    model = Model(tables, bits)
    model.fit_levels(_levels(rows, halves), calibration)
    return model


def word_counts(docs: DataFrame, text: str = "__text") -> DataFrame:
    """(word, n): how often each word, a 64-bit hash, stands in all texts."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            w, where = np.unique(np.concatenate(words), return_inverse=True)
            return w, np.bincount(where, np.concatenate(counts), len(w)).astype(np.int64)

        def out(w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])

        for b in batches:
            for _, _, data, offs in tokens.blocks(b.column(text)):
                w, n = np.unique(tokens.Words(data, offs).hash, return_counts=True)
                words.append(w)
                counts.append(n)
                held += len(w)
                if held > 1 << 20:
                    w, n = merged()
                    words, counts, held = [w], [n], len(w)
                    if held > 1 << 19:
                        yield out(w, n)
                        words, counts, held = [], [], 0
        if held:
            yield out(*merged())

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), n_bytes and bits_per_byte of every row."""
    import pyarrow as pa
    from pyspark import TaskContext

    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    counts = scratch.save(word_counts(docs.where("NOT held_out").select("__text")), "counts")
    ends = docs.where("NOT held_out").count()
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    below = total + 0.1 * (distinct + 1)
    hot = counts.where(F.col("n") * HOT >= total).orderBy(F.col("word")).toArrow() if ends else None  # HOT rows at most
    names = hot.column("word").to_numpy().view(np.uint64) if ends else np.zeros(0, np.uint64)
    order = np.argsort(names)
    chance = np.log10((hot.column("n").to_numpy()[order] + 0.1) / below) if ends else np.zeros(0)
    end = (ends > 0, float(np.log10((ends + 0.1) / below)))
    shared = spark.sparkContext.broadcast((model, names[order], chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names, chance = shared.value
        row_id = TaskContext.get().partitionId() << 36
        for b in batches:
            n = b.num_rows
            bits, symbols = model.cost(b.column("__text"), n)
            n_tokens, n_known, base = np.ones(n, np.int64), np.full(n, int(end[0])), np.full(n, end[1])
            words, often, ends_at = [], [], []
            for lo, hi, data, offs in tokens.blocks(b.column("__text")):
                w = tokens.Words(data, offs)
                row = np.repeat(np.arange(hi - lo), np.diff(w.bounds))
                n_tokens[lo:hi] += np.diff(w.bounds)
                at = np.minimum(np.searchsorted(names, w.hash), max(len(names) - 1, 0))
                known = names[at] == w.hash if len(names) else np.zeros(len(w.hash), bool)
                n_known[lo:hi] += np.bincount(row[known], minlength=hi - lo)
                base[lo:hi] += np.bincount(row[known], chance[at[known]], hi - lo) if known.any() else 0.0
                row, own = row[~known], w.hash[~known]
                by = np.lexsort((own, row))
                row, own = row[by], own[by]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (own[1:] != own[:-1])])) if len(row) else np.zeros(0, np.int64)
                words.append(own[new])
                often.append(np.diff(new, append=len(row)))
                ends_at.append(np.bincount(row[new], minlength=hi - lo))
            at = np.concatenate([[0], np.cumsum(np.concatenate(ends_at))]).astype(np.int32) if n else np.zeros(1, np.int32)
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            rare = [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in (join(words, np.uint64).view(np.int64), join(often, np.int64))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_id + np.arange(n)), b.column("doc_id"), b.column("held_out"), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(symbols), pa.array(bits), *rare],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "n_bytes", "bits", "words", "often"],
            )
            row_id += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = docs.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, n_bytes long, bits double, words array<long>, often array<long>")
    each = scratch.save(each, "scored")  # rows keep their numbers from here on
    rare = each.select("row", F.explode(F.arrays_zip("words", "often")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.often").alias("tf"))
    rare = rare.join(counts.where(F.col("n") * HOT < total).hint("merge"), "word", "left")
    chance = F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.1)) / F.lit(below))
    rare = rare.groupBy("row").agg(F.sum(F.col("tf") * chance).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    joined = each.drop("words", "often").join(rare.hint("merge"), "row", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("bits") * F.lit(-float(np.log10(2)))).alias("score"),
        (F.col("n_bytes") - 1).alias("n_bytes"),
        (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
