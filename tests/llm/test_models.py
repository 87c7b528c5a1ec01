import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import ann, decontaminate, language_id, samples, toxicity

WORDS = {
    "aa": "lorem dolor amet sit ipsum vero elit nunc".split(),
    "bb": "kvitre stjerne blåbær fjord skog høst".split(),
    "cc": "над лес река гора снег дом".split(),
}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))), lang))
    return rows


def test_language_kernel_held_out_accuracy_and_edges(spark):
    rows = corpus(300)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !?", None), (1003, "é", None), (1004, "lorem ipsum " * 20_000, None), (1004, "lorem ipsum", "aa"), (None, "lorem dolor", "aa")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language_id.identify(df, language_id.train(df), keep=["doc_id", "text", "lang", "score"]).withColumn("fold", samples.fold(F.col("doc_id"))).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.fold == 2 and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    of = {r.doc_id: r for r in got}
    assert [of[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and of[1000].score == 0
    assert of[1003].lang_pred != "und" and of[1004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "lorem", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language_id.identify(df, language_id.train(df)).collect()] == [("und", 0.0)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(empty, language_id.train(empty)).collect() == []


def test_kernel_matches_sets():
    texts = [b"abc abd", b"zz top", b"ab"]
    model = language_id.Model(texts, ["x", "y", "x"], landmarks=3)
    spectrum = language_id.Spectrum(model.known)
    data, offs = language_id._join([b"abc", b"Top z"])
    got = model._kernel(spectrum, data, offs)
    order = [texts[i] for i in (0, 2, 1)]  # landmarks by language

    def grams(t, n):
        t = bytes(c | 32 if 65 <= c <= 90 else c for c in t)
        return {t[i : i + n] for i in range(len(t) - n + 1)} & {m[i : i + n] for m in order for i in range(len(m) - n + 1)}

    for i, t in enumerate([b"abc", b"Top z"]):
        for j, m in enumerate(order):
            want = np.mean([len(grams(t, n) & grams(m, n)) / max(1, np.sqrt(len(grams(t, n)))) / max(1, np.sqrt(len(grams(m, n)))) for n in (1, 2, 3)])
            assert got[i, j] == pytest.approx(want, abs=1e-5)


def test_chain_messages_match_enumeration():
    rng = np.random.default_rng(2)
    e, a = rng.normal(0, 1, 6), rng.normal(0, 1, (2, 2))
    bounds = np.array([0, 4, 4, 6])
    f, b = toxicity._chain(e, bounds, a)
    p = toxicity._sigmoid(f + b)
    for lo, hi in ((0, 4), (4, 6)):
        n, total, marginal = hi - lo, 0.0, np.zeros(hi - lo)
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(e[lo + k] * y[k] for k in range(n)) + sum(a[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            marginal += w * np.array(y)
        assert p[lo:hi] == pytest.approx(marginal / total)


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    plain, bad = [f"w{i}" for i in range(60)], ["vilex", "vilest", "scumm"]
    rows, labels = [], []
    for i in range(500):
        toxic = rng.random() < 0.25
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 50))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "plain " * 100_000 + "vilex scumm vilest"), (902, "w1")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5000, 1), (5001, None)], "doc_id long, toxic int")
    got = toxicity.tag(docs, toxicity.train(docs, known)).withColumn("held", samples.fold(F.col("doc_id")) == 2).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id < 500]
    good = sum((r.score >= toxicity.THRESHOLD) == bool(labels[r.doc_id][1]) for r in held)
    assert len(held) > 60 and good / len(held) > 0.95
    for r in got:
        text = rows[r.doc_id][1] if r.doc_id < 500 else None
        if text:
            assert all(text[s.start : s.end] in bad for s in r.spans)
    long = max((r for r in got if r.doc_id == 902), key=lambda r: r.score)
    assert long.n_toxic_words == 3 and [s.start for s in long.spans] == [600_000, 600_006, 600_012]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.tag(docs, toxicity.train(docs, none)).first().score == pytest.approx(0, abs=1e-5)
    assert toxicity.tag(docs.limit(0), toxicity.train(docs, none)).collect() == []


def test_decontamination(spark):
    rng = random.Random(4)
    words = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    items = [(i, words(rng.randrange(14, 60))) for i in range(12)] + [(90, words(5)), (91, [])]
    rows, want = [], set()
    for d in range(60):
        text = words(rng.randrange(0, 60))
        if d % 3 == 0:
            k, w = items[rng.randrange(12)]
            copy = [x if i % 7 else "subst" for i, x in enumerate(w)] if d % 2 else list(w)
            text += copy + words(10)
            want.add((d, k))
        rows.append((d, " ".join(text).upper() if d % 4 == 0 else ", ".join(text), 1))
    rows += [(100, None, 1), (101, "", 1), (102, " ".join(items[12][1]), 1), (103, " ".join(words(20_000) + items[0][1]), 1), (3, rows[3][1], 1)]
    want.add((103, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(92, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, tests).collect()}
    assert set(got) == want
    assert got[(103, 0)].doc_at == 20_000 and got[(103, 0)].item_at == 0
    assert all(r.n_equal >= 0.75 * r.n_window for r in got.values())
    assert decontaminate.matches(docs.limit(0), tests).collect() == [] and decontaminate.matches(docs, tests.limit(0)).collect() == []


def test_masks_miss_no_accepted_pattern():
    for n in range(decontaminate.SHORTEST, decontaminate.WINDOW + 1):
        for masks in (decontaminate.MASKS, decontaminate.LONG_MASKS) if n == decontaminate.WINDOW else (decontaminate.MASKS,):
            assert all(m[-1] >= len(m) for m in masks)  # each ignores some position
            for gone in itertools.combinations(range(n), n - math.ceil(decontaminate.AGREE * n)):
                assert any(at + m[-1] < n and not any(at + o in gone for o in m) for m in masks for at in range(n)), (n, gone)


def test_decontamination_at_text_ends_and_of_long_items(spark):
    """Marks at the ends of texts make no words, and an item of 100,000 words takes no more than its words."""
    item = [f"e{j}" for j in range(12)]
    near = [w if j not in (1, 5, 9) else "x" for j, w in enumerate(item)]
    long = [f"l{j}" for j in range(100_000)]
    rows = [(1, " ".join(near)), (2, " ".join(near) + "."), (3, "(" + ", ".join(near) + "!)"), (4, "a b c d e."), (None, " ".join(item)), (5, " ".join(long[90_000:90_030]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS lag", "2 AS n", "3 AS item_id")
    tests = spark.createDataFrame([(1, ". " + " ".join(item) + "."), (2, "a b c d e."), (3, " ".join(long))], "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, tests).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (None, 1), (5, 3)}
    assert all(got[i, 1].n_equal == 9 and got[i, 1].doc_at == 0 for i in (1, 2, 3)) and got[5, 3].item_at == 90_000


def test_decontamination_of_dense_substitutions_and_short_items(spark):
    item = {k: [f"i{k}q{j}" for j in range(n)] for k, n in enumerate((16, 20, 40, 6, 8, 9))}
    copy = lambda k, gone: " ".join(["before", *["x" if j in gone else w for j, w in enumerate(item[k])], "after"])
    rows = [(0, copy(0, (3, 7, 11, 15))), (1, copy(1, (3, 7, 11, 15, 19))), (2, copy(2, range(3, 40, 4))), (3, copy(3, ())), (4, copy(4, (2, 5))), (5, copy(5, (4, 8))), (6, copy(0, (1, 3, 7, 11, 15)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in item.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, tests).collect()} == {(k, k) for k in range(6)}


def test_decontamination_by_shuffle(spark, monkeypatch):
    text = " ".join(f"q{i}" for i in range(30))
    docs, tests = spark.createDataFrame([(1, "x " + text)], "doc_id long, text string"), spark.createDataFrame([(2, text)], "item_id long, text string")
    whole = decontaminate.matches(docs, tests).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 1)
    assert decontaminate.matches(docs, tests).collect() == whole and len(whole) == 1


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 16)
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=8)).tolist()) for i in range(800)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # copies of a query
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] * 8), (2300, [1.0, None, *[0.0] * 6]), (2400, [1.0]), (2500, []), (None, rows[0][1]), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit(1))
    got = ann.search(df).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and (i < 2000)}
    ids, x = np.array(sorted(good)), np.array([good[i] for i in sorted(good)])
    queries = [i for i in ids if i % 100 == 0]
    hit = 0
    for q in queries:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        d = np.sqrt(((x - good[q]) ** 2).sum(1))
        assert [r.score for r in own] == pytest.approx([d[ids == r.vec_id][0] for r in own], abs=1e-12)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own) and q not in [r.vec_id for r in own]
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hit += len({int(ids[i]) for i in order} & {r.vec_id for r in own})
    assert {r.query_id for r in got} == set(queries)
    assert hit >= 0.9 * 10 * len(queries)
    copies = [r.vec_id for r in got if r.query_id == 0]
    assert sorted(copies) == list(range(1000, 1010))  # the smallest ids of equal vectors


def test_vectors_of_several_lengths(spark):
    """A short vector at the smallest id keeps nobody out, and each length finds its own."""
    rng = np.random.default_rng(8)
    rows = [(0, [1.0]), (1, [3.0]), (100, [0.5])] + [(i, rng.normal(size=6).tolist()) for i in range(200, 500)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got if r.query_id < 200} == {(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)}
    assert {r.query_id for r in got} == {0, 100, 200, 300, 400} and sum(r.query_id >= 200 for r in got) == 30
    assert all(r.vec_id >= 200 for r in got if r.query_id >= 200)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 1.0]), (9, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df).orderBy("rank").collect()] == [(0, 1, 9), (0, 2, 7)]
    assert ann.search(df.limit(0)).collect() == []
