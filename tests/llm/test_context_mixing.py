"""Context mixing: probabilities that add up, counts by hand, held-out gain, and the word unigram by brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import context_mixing as cm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small_model(texts, bits=(12, 12, 12)):
    counts = cm.empty_counts(bits)
    cm.count_halves(pa.array(texts, pa.large_string()), bits, counts)
    return cm.Model([cm.log_odds(c) for c in counts], bits)


def bits_of(model, *texts):
    return model.cost(pa.array(texts, pa.large_string()), len(texts))[0]


def test_probabilities_of_the_next_symbol_add_up():
    """The last symbol costs what is left of the whole; over all 256 values of it the probabilities add up to one."""
    model = small_model(["the cat sat on the mat", "the dog sat"] * 5)
    data = np.frombuffer(b"the ca", np.uint8)
    total = 0.0
    for value in range(256):
        piece = cm._piece(np.append(data, np.uint8(value)), np.array([0, 7]), 0, 6, 0, False)
        x, gate, sign = model.inputs(piece.symbol, piece.context)
        z = sum(x[c] * model.weight[:, c][gate] for c in range(len(cm.CONTEXTS)))
        total += np.exp(-np.log1p(np.exp(-sign * z)).sum())
    assert total == pytest.approx(1, abs=1e-5)


def test_counts_of_bits_follow_from_halves():
    halves = np.zeros(16, np.uint32)
    halves[[0b0000, 0b0111, 0b1111]] = [5, 3, 2]
    odds = cm.log_odds(halves)
    assert odds[1] >> 2 == round(math.log(2.4 / 8.4) * cm.SCALE) and odds[1] & 3 == 2  # first bit: 8 times 0, twice 1
    assert odds[2] >> 2 == round(math.log(3.4 / 5.4) * cm.SCALE)  # after 0
    assert odds[4] >> 2 == round(math.log(0.4 / 5.4) * cm.SCALE) and odds[5] >> 2 == round(math.log(3.4 / 0.4) * cm.SCALE)
    assert odds[12] == 0  # never seen


def test_contexts_see_the_past_alone():
    a, b = "some words before x and more", "some words before y other end"
    pieces = [next(iter(cm.pieces(pa.array([t], pa.large_string())))) for t in (a, b)]
    same = a.index("x") + 1
    assert (pieces[0].context[:, :same] == pieces[1].context[:, :same]).all()
    alone = next(iter(cm.pieces(pa.array(["other text", a], pa.large_string()))))
    assert (alone.context[:, alone.row == 1] == pieces[0].context).all()


def test_long_texts_in_pieces_cost_the_same(monkeypatch):
    text = " ".join(f"word{i % 37} and-a-very-long-word-{'x' * (i % 50)}" for i in range(300))
    model = small_model([text, "other"])
    whole = bits_of(model, text, "", "é")
    monkeypatch.setattr(cm, "BLOCK", 1024)
    assert bits_of(model, text, "", "é") == pytest.approx(whole, rel=1e-4)


def test_training_helps_and_adapting_helps():
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    trained, blank = small_model(texts[:50], (14, 16, 16)), small_model([])
    before = bits_of(trained, *texts[50:]).sum()
    assert before < 0.6 * bits_of(blank, *texts[50:]).sum()
    trained.fit(pa.array(texts[:10], pa.large_string()))
    assert bits_of(trained, *texts[50:]).sum() < before
    odd = "alpha beta " * 400
    adapted, fixed = (trained.cost(pa.array([odd], pa.large_string()), 1, step)[0][0] for step in (cm.STEP, 0.0))
    assert adapted < fixed
    n = len(texts[50].encode()) + 1
    assert bits_of(blank, texts[50])[0] == pytest.approx(8 * n)


def brute(docs):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    counts, ends = Counter(), 0
    for i, t in docs:
        if not out(i):
            counts.update(WORD.findall(low(t)))
            ends += 1
    total = sum(counts.values()) + ends
    below = total + 0.1 * (len(counts) + (ends > 0) + 1)
    rows = []
    for i, t in docs:
        words = WORD.findall(low(t))
        rows.append((i, out(i), len(words) + 1, sum(counts[w] > 0 for w in words) + (ends > 0), total, sum(math.log10((counts[w] + 0.1) / below) for w in words) + math.log10((ends + 0.1) / below)))
    return rows


DOCS = [(i, " ".join(f"W{j % (i % 7 + 2)} w{i}" for j in range(i % 40))) for i in range(150)] + [(7, None), (8, ""), (9, " \t\n"), (None, "w1 w2"), (5, "w1 w1"), (5, "w1 w1"), (3, "é É a\xa0b"), (4, "long " * 30_000)]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(cm, "HOT", 30)  # so that words are looked up and joined
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS row", "'x' AS held_out")
    model = cm.train(df, bits=(14, 16, 16), calibration=20)
    got = sorted(cm.score(df, model).collect(), key=lambda r: str(r))
    want = brute(DOCS)
    key = lambda r: (str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 6))
    assert sorted(key(tuple(r)[:6]) for r in got) == sorted(map(key, want))
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / (r.n_bytes + 1)) for r in got)
    same = [r.score for r in got if r.doc_id == 5 and r.n_tokens == 3]
    assert len(same) == 2 and same[0] == same[1]
    again = {(r.doc_id, r.n_tokens): r.score for r in cm.score(df.repartition(7), cm.train(df.repartition(5), bits=(14, 16, 16), calibration=20)).collect()}
    assert all(again[r.doc_id, r.n_tokens] == pytest.approx(r.score, rel=1e-5) for r in got)  # however the rows are dealt


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = sorted(cm.score(df, cm.train(df)).collect(), key=lambda r: r.n_tokens)
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert [r.score for r in rows] == pytest.approx([-8 * math.log10(2), -32 * math.log10(2)])
    assert cm.score(df.limit(0), cm.train(df.limit(0))).count() == 0


def test_all_training_documents_are_counted_and_weighed(spark):
    long = [(i, f"alpha {i} beta gamma " * 900) for i in range(12)]  # too long for a small sample
    assert len(long[0][1]) > 1 << 14
    docs = spark.createDataFrame([*long, (20, "delta epsilon")], "doc_id long, text string")
    rows = docs.selectExpr("text AS __text", "pmod(xxhash64(doc_id, text), 2) AS __half").where(~cm.held_out(docs.doc_id))
    bits = (12, 14, 14)
    tables, halves = cm._tables(rows, bits)
    kept = [[r["__text"] for r in rows.collect() if r["__half"] == h] for h in (0, 1)]
    assert all((a == b).all() for a, b in zip(tables, small_model(kept[0] + kept[1], bits).tables, strict=True))
    levels = cm._levels(rows, halves)
    assert levels.sum() == 8 * sum(len(t) + 1 for k in kept for t in k)
    want = np.zeros_like(levels)
    for own, other in (kept, kept[::-1]):
        cm.count_levels(pa.array(own, pa.large_string()), cm.level_paths([cm.levels(t) for t in small_model(other, bits).tables]), bits, want)
    assert (levels == want).all()
    assert abs(cm.train(docs, bits=bits).weight - 0.3).max() > 0.1


def test_the_fit_finds_the_better_predictor():
    """Bits of the gate of the first bit and no confidence: one predictor is right nine times of ten at log-odds of 1.9, the others say nothing of it."""
    counts = np.zeros((8, 4, 16, 4, 16, 16), np.int64)
    counts[0, 0, 7, 0, 7, 7 + 3], counts[0, 0, 7, 0, 7, 7 - 3] = 9000, 1000
    model = small_model([])
    model.fit_levels(counts.reshape(8, -1))
    assert model.weight[0] == pytest.approx([math.log(9) / 1.9, 0.3, 0.3], abs=0.01)
    assert (model.weight[1:] == np.float32(0.3)).all()


def test_groups_of_texts_that_are_mixed_at_once_change_nothing(monkeypatch):
    texts = [f"word{i} other{i * i} " * (i * 7 % 90) for i in range(40)]
    model = small_model(texts[::2])
    whole = bits_of(model, *texts)
    for group, part in ((1, 1 << 13), (700, 64)):
        monkeypatch.setattr(cm, "GROUP", group)
        monkeypatch.setattr(cm, "SLICE", part)
        assert bits_of(model, *texts) == pytest.approx(whole, rel=1e-5)


def test_texts_are_mixed_in_order_of_length(monkeypatch):
    """A piece has as many turns as its longest text, so short and long ones that alternate would be mixed in many small groups."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefgh XYZ é"), n)) for n in np.tile([5000, 0] + [400] * 20, 10)]
    model, seen, pieces = small_model(texts), [], cm.pieces

    def spied(texts):
        for p in pieces(texts):
            seen.append(int(p.place.max()) // cm.CHUNK + 1)
            yield p

    monkeypatch.setattr(cm, "BLOCK", 1 << 15)
    alone = [model.cost(pa.array([t], pa.large_string()), 1) for t in texts]
    monkeypatch.setattr(cm, "pieces", spied)
    bits, symbols = model.cost(pa.array(texts, pa.large_string()), len(texts))
    assert np.allclose(bits, [b[0] for b, _ in alone], rtol=1e-6) and list(symbols) == [s[0] for _, s in alone]
    assert sum(seen) < 40  # turns of all pieces


def test_words_so_far_are_those_of_their_bytes():
    from skein.llm import tokens

    texts = ["Ab cd", "", "x" * 70 + " yé", "tail"]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    got = tokens.Words(data, offs, tokens.ALNUM).so_far(32, np.uint64(3))
    for lo, hi in zip(offs[:-1], offs[1:], strict=True):
        for i in range(lo, hi):
            start = i
            while start > lo and tokens.ALNUM[data[start - 1]]:
                start -= 1
            want = sum(int(tokens.BYTE_VALUE[tokens.LOWER[data[j]]]) * pow(0x9E3779B97F4A7C15, j - max(start, i - 32), 1 << 64) for j in range(max(start, i - 32), i))
            assert int(got[i]) == want * 3 % (1 << 64)
