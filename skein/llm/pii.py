"""Personal data: exact rules, and a character BiLSTM with CRF transitions that adds to them.

Rules find e-mail addresses, IP addresses, card numbers and phone numbers. They are
the base: leftmost matches of each kind, failing ones dropped. The tagger is a
bidirectional LSTM over characters whose outputs, with transition scores, form a
linear-chain CRF over the tags none, email, ip, card and phone. It is trained in
numpy, by back-propagation of the CRF's likelihood, from labelled spans: the base
spans of about ``DOCS`` documents (by a hash of doc_id) and generated ones, some
of them written as the rules don't see them (no plus, dots in card numbers, blanks
around an at sign), with numbers that aren't personal among them.

Every span holds a digit or an at sign. Under that constraint a stretch without
one can hold no tag but none, so only the characters within ``REACH`` of one are
run through the network, over the whole text. They are cut into windows of
``WINDOW`` that overlap by half; each is decoded (Viterbi), and for each character
the windows vote, with more weight the farther it lies from a window's edge. Runs
of one tag become spans, which must hold what their kind needs (9 to 15 digits for
a phone number, 12 to 19 for a card and so on) and must not touch a base span.

Null texts count as empty and have no spans. Repeated rows get the same result
each. An empty table gives an empty result (and a tagger of generated spans).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import samples, tokens
from skein.storage import ship_package

KINDS = ("email", "ip", "card", "phone")
DOCS = 800
GENERATED = 1600
WINDOW = 64
REACH = 32
HIDDEN = 16
EMBED = 10
EPOCHS = 8

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a later start in a run of digits fails as its first does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, sorted."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # the local part reaches left from an at sign as far as its characters do
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_SYMBOLS = "abcdefghijklmnopqrstuvwxyz.@+-()_%:/,;'\"#="
DIGIT, SPACE, OTHER, PAD = len(_SYMBOLS), len(_SYMBOLS) + 1, len(_SYMBOLS) + 2, len(_SYMBOLS) + 3
_CODE = np.full(128, OTHER, np.int64)
for _i, _c in enumerate(_SYMBOLS):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i
_CODE[48:58] = DIGIT
_CODE[[9, 10, 11, 12, 13, 32]] = SPACE


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], OTHER)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Weights of the network and its transitions."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        tags = len(KINDS) + 1
        self.w = {"e": rng.normal(0, 0.3, (PAD + 1, EMBED)), "o": rng.normal(0, 0.2, (2 * HIDDEN, tags)), "ob": np.zeros(tags), "t": np.zeros((tags, tags))}
        for d in "fb":
            self.w[d] = rng.normal(0, 0.2, (EMBED + HIDDEN, 4 * HIDDEN))
            self.w[d + "b"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gates start open

    def _lstm(self, x: np.ndarray, d: str, keep: bool = False):
        """Outputs (time, batch, hidden) of one direction; what the backward pass needs, if kept."""
        w, b, (steps, n, _) = self.w[d], self.w[d + "b"], x.shape
        inner = x @ w[:EMBED] + b
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, held = np.empty((steps, n, HIDDEN)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inner[t] + h @ w[EMBED:]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, c0 = h, c
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            if keep:
                held.append((t, before, c0, f, i, o, g, s))
        return out, held

    def emissions(self, codes: np.ndarray, keep: bool = False):
        """Scores (time, batch, tag) of windows (batch, time)."""
        x = self.w["e"][codes.T]
        (hf, kf), (hb, kb) = self._lstm(x, "f", keep), self._lstm(x, "b", keep)
        h = np.concatenate([hf, hb], 2)
        return h @ self.w["o"] + self.w["ob"], (x, h, kf, kb)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) by Viterbi."""
        e, _ = self.emissions(codes)
        score, back = e[0], []
        for t in range(1, len(e)):
            m = score[:, :, None] + self.w["t"][None]
            back.append(m.argmax(1))
            score = m.max(1) + e[t]
        tag = score.argmax(1)
        out = [tag]
        for b in reversed(back):
            tag = b[np.arange(len(tag)), tag]
            out.append(tag)
        return np.array(out[::-1]).T

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> dict:
        """Gradient of the mean log likelihood of tagged windows; padding has the tag none."""
        e, (x, h, kf, kb) = self.emissions(codes, keep=True)
        steps, n, k = e.shape
        y, trans = tags.T, self.w["t"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        lse = lambda m, axis: (lambda top: (np.log(np.exp(m - top).sum(axis, keepdims=True)) + top).squeeze(axis))(m.max(axis, keepdims=True))
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans[None], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = -np.exp(alpha + beta - z[None, :, None])
        de[np.arange(steps)[:, None], np.arange(n)[None, :], y] += 1
        pair = np.exp(alpha[:-1][..., None] + trans + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:-1].ravel(), y[1:].ravel()), 1)
        g = {"t": seen - pair, "o": h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, k), "ob": de.sum((0, 1))}
        dh, dx = de @ self.w["o"].T, np.zeros_like(x)
        for d, held, own in (("f", kf, dh[..., :HIDDEN]), ("b", kb, dh[..., HIDDEN:])):
            w = self.w[d]
            dw, db, hn, cn = np.zeros_like(w), np.zeros(4 * HIDDEN), np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for t, before, c0, f, i, o, gg, s in reversed(held):
                dht = own[t] + hn
                dc = dht * o * (1 - s * s) + cn
                dz = np.concatenate([dc * c0 * f * (1 - f), dc * gg * i * (1 - i), dht * s * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                dw[:EMBED] += x[t].T @ dz
                dw[EMBED:] += before.T @ dz
                db += dz.sum(0)
                dx[t] += dz @ w[:EMBED].T
                hn, cn = dz @ w[EMBED:].T, dc * f
            g[d], g[d + "b"] = dw, db
        g["e"] = np.zeros_like(self.w["e"])
        np.add.at(g["e"], codes.T.ravel(), dx.reshape(-1, EMBED))
        return {name: v / n for name, v in g.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, batch: int = 64, seed: int = 5) -> Tagger:
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                step += 1
                for k, g in self.gradient(codes[own], tags[own]).items():
                    g = np.clip(g, -5, 5)
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] += 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of a text within REACH of a digit or an at sign."""
    out: list[list[int]] = []
    for m in re.finditer(r"[0-9@]+", text):
        lo, hi = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def windows(lo: int, hi: int) -> list[int]:
    """Starts of overlapping windows over a stretch; the last reaches its end."""
    starts = list(range(lo, max(lo + 1, hi - WINDOW + 1), WINDOW // 2))
    return starts if starts[-1] + WINDOW >= hi else [*starts, hi - WINDOW]


def _cut(codes: np.ndarray, at: int) -> np.ndarray:
    part = codes[at : at + WINDOW]
    return np.pad(part, (0, WINDOW - len(part)), constant_values=PAD)


def plausible(kind: int, s: str) -> bool:
    """What a span that only the tagger found must hold."""
    n = len(_digits(s))
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9-]+(\s*\.\s*[A-Za-z0-9-]+)+", s))
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and "." in s
    if kind == 2:
        return 12 <= n <= 19 and luhn(_digits(s)) and not re.search(r"[^0-9\s.\-]", s)
    return 9 <= n <= 15 and not re.search(r"[^0-9\s().+\-]", s)


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the tagger adds to the base."""
    where, cuts, coded = [], [], [encode(t) for t in texts]
    for i, t in enumerate(texts):
        for lo, hi in stretches(t):
            for at in windows(lo, hi):
                where.append((i, lo, hi, at))
                cuts.append(_cut(coded[i], at))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not cuts:
        return out
    cuts = np.array(cuts)
    tags = np.concatenate([tagger.decode(cuts[a : a + 512]) for a in range(0, len(cuts), 512)])
    weight = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(float)
    first = 0
    while first < len(where):
        i, lo, hi, _ = where[first]
        last = first
        votes = np.zeros((hi - lo, len(KINDS) + 1))
        while last < len(where) and where[last][:3] == (i, lo, hi):
            at = where[last][3]
            n = min(WINDOW, hi - at)
            skip = max(0, lo - at)
            votes[np.arange(at + skip, at + n) - lo, tags[last][skip:n]] += weight[skip:n]
            last += 1
        tag = votes.argmax(1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], tag, [0]])))
        for a, b in zip(edges, edges[1:], strict=False):
            if not tag[a]:
                continue
            start, end = lo + int(a), lo + int(b)
            while start < end and texts[i][start].isspace():
                start += 1
            while end > start and (texts[i][end - 1].isspace() or texts[i][end - 1] in ".,;:("):
                end -= 1
            if plausible(int(tag[a]) - 1, texts[i][start:end]) and not any(s < end and start < e for s, _, e in bases[i]):
                out[i].append((start, int(tag[a]) - 1, end))
        first = last
    return out


def _generate(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up text with labelled spans."""
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    num = lambda n: "".join(str(c) for c in rng.integers(0, 10, n))
    words = lambda: " ".join(word() for _ in range(rng.integers(1, 5)))
    text, spans, kind = words() + " ", [], int(rng.integers(0, 5)) - 1
    odd = rng.random() < 0.5  # as the rules don't see it
    if kind == 0:
        at = rng.choice([" @ ", " @", "@ "]) if odd else "@"
        s = word() + str(rng.choice(["", ".", "_"])) + word() + at + str(rng.choice(["", word() + "."])) + word() + "." + str(rng.choice(["com", "org", "net", "example", "co.uk"]))
    elif kind == 1:
        s = str(rng.choice([" . ", " ."]) if odd else ".").join(str(x) for x in rng.integers(0, 256, 4))
    elif kind == 2:
        d = num(15)
        d = next(d + str(c) for c in range(10) if luhn(d + str(c)))
        s = str(rng.choice([".", "  ", " - "]) if odd else rng.choice(["", " ", "-"])).join(d[i : i + 4] for i in range(0, 16, 4))
    elif kind == 3:
        a, b, c = num(3), num(3), num(4)
        s = str(rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{num(2)} {a} {b} {c}"])) if odd else "+" + str(rng.choice([f"1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{num(2)} ({a}) {b} {c}", f"1{a}{b}{c}"]))
    else:
        s = str(rng.choice([num(4), num(6), num(9), f"{num(4)}-{num(2)}-{num(2)}", f"{num(1)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", f"{word()}{num(3)}", f"#{num(5)}", f"${num(3)}.{num(2)}", "@" + word(), f"{num(2)}:{num(2)}", num(20)]))
    if kind >= 0:
        spans.append((len(text), kind, len(text) + len(s)))
    return text + s + str(rng.choice([" ", ". ", ", ", "\n"])) + words(), spans


def examples(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags from documents (labelled by the rules) and generated texts."""
    rng = np.random.default_rng(seed)
    labelled = [(t, base_spans(t)) for t in texts] + [_generate(rng) for _ in range(GENERATED)]
    codes, tags = [], []
    for text, spans in labelled:
        coded, tag = encode(text), np.zeros(len(text), np.int64)
        for start, kind, end in reversed(spans):  # of overlapping spans the first counts
            tag[start:end] = kind + 1
        own = [at for lo, hi in stretches(text) for at in windows(lo, hi)][:40]
        for at in own:
            codes.append(_cut(coded, at))
            tags.append(np.pad(tag[at : at + WINDOW], (0, WINDOW - len(tag[at : at + WINDOW]))))
    if len(codes) > 4000:
        pick = rng.permutation(len(codes))[:4000]
        codes, tags = [codes[i] for i in pick], [tags[i] for i in pick]
    return np.array(codes), np.array(tags)


def train(docs: DataFrame, most: int = DOCS, key: str = "doc_id", text: str = "text") -> Tagger:
    """A tagger from the base spans of a bounded sample of documents that hold a digit or an at sign, and generated spans."""
    some = docs.where(F.col(text).rlike("[0-9@]") & (F.length(text) <= 20_000)).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    # Ids are chosen first, by salt; a sorted limit would send each task's share of texts to the driver.
    chosen = samples.per_class(some.select("doc_id", F.lit(0).alias("all")), "all", most).select("doc_id").distinct()
    got = some.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return Tagger().fit(*examples(list(got.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()["text"])))


def find(docs: DataFrame, tagger: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (start, kind, end) in code points, by start, of every row."""
    import pyarrow as pa

    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    anchor = np.zeros(256, bool)
    anchor[48:58] = anchor[64] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for lo, _, data, offs in tokens.blocks(batch.column("__text")):
                has = np.diff(np.concatenate([[0], np.cumsum(anchor[data])])[offs]) > 0
                rows = np.flatnonzero(has)
                texts = [data[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "surrogatepass") for r in rows]
                own = [base_spans(t) for t in texts]
                for r, b, a in zip(rows, own, added_spans(texts, own, shared.value), strict=True):
                    base[lo + r], added[lo + r] = b, a
            struct = lambda x: pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in row] for row in x], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), struct(base), struct(added)], names=["doc_id", "base", "added"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    spans = "array<struct<start:int,kind:int,end:int>>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {spans}, added {spans}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of the base, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    as_text = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(as_text(F.col("base")), 256).alias("base_sha256"),
        as_text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def sha(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest()
