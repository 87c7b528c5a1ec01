"""Variable-block-max WAND against scores of all documents; the boundaries against all partitions."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import lexical_search
from skein.llm.lexical_search import ATOM, BLOCK_COST, Shard, cut_blocks, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def made(rng, n, vocabulary, long=80):
    words = [f"w{i}" for i in range(vocabulary)]
    p = 1 / np.arange(1, vocabulary + 1)
    return [" ".join(rng.choice(words, rng.integers(0, long), p=p / p.sum())) for _ in range(n)]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("postings", [200, 1_000_000])
def test_search_is_exact(spark, postings):
    rng = np.random.default_rng(1)
    docs = [(int(i), t) for i, t in zip(rng.permutation(700), made(rng, 700, 150), strict=True)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [docs[5], docs[5]]  # copies tie, repeated rows stand twice
    docs += [(None, "w1 w2 w3"), (2000, None), (2001, ""), (2002, "... --"), (2003, "W1 É Été été w1-w2_w3")]
    items = list(enumerate(made(rng, 12, 150, 30))) + [(20, None), (21, "nowhere"), (22, "W1, w2! ÉTÉ Été"), (0, "w5 w5 w6"), (None, "w3")]
    d, i = frames(spark, docs, items)
    got = sorted((tuple(r) for r in search(d.repartition(3), i, 7, postings=postings).collect()), key=str)
    assert got == brute(docs, items, 7)


def test_parts_of_items(spark):
    rng = np.random.default_rng(2)
    docs, items = list(enumerate(made(rng, 150, 60))), list(enumerate(made(rng, 9, 60, 20)))
    d, i = frames(spark, docs, items)
    got = sorted((tuple(r) for r in search(d, i, 5, most_terms=20).collect()), key=str)
    assert got == brute(docs, items, 5)


def test_empty_tables_and_clashing_columns(spark):
    d, i = frames(spark, [(1, "a b")], [(1, "a")])
    assert search(d.limit(0), i).count() == 0 and search(d, i.limit(0)).count() == 0
    more = d.selectExpr("*", "1 AS term", "2 AS score", "3 AS rank", "4 AS item_id", "5 AS n", "6 AS __x")
    assert [tuple(r) for r in search(more, i.selectExpr("*", "7 AS doc_id", "8 AS term")).collect()] == brute([(1, "a b")], [(1, "a")], 10)
    with pytest.raises(ValueError):
        search(d, i, 0)


def test_long_text(spark):
    docs = [(1, "word " * 200_000 + "rare"), (2, "rare word"), (3, "other")]
    d, i = frames(spark, docs, [(1, "rare word")])
    assert sorted((tuple(r) for r in search(d, i).collect()), key=str) == brute(docs, [(1, "rare word")], 10)


def best_partition(score, cost):
    """The least error of all partitions into blocks of whole runs."""
    runs = [score[i : i + ATOM] for i in range(0, len(score), ATOM)]
    best = [0.0]
    for j in range(1, len(runs) + 1):
        best.append(min(best[i] + cost + sum(len(r) for r in runs[i:j]) * max(max(r) for r in runs[i:j]) - sum(sum(r) for r in runs[i:j]) for i in range(max(0, j - lexical_search.WIDEST), j)))
    return best[-1]


def test_boundaries_have_the_least_error():
    rng = np.random.default_rng(4)
    lists = [rng.integers(1, 1000, n) for n in (1, 8, 9, 100, 777, 0, 300)] + [np.full(200, 5), np.sort(rng.integers(1, 9999, 400))]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    starts = cut_blocks(np.concatenate(lists), bounds)
    for lo, hi, x in zip(bounds[:-1], bounds[1:], lists, strict=True):
        if not len(x):
            continue
        own = starts[(starts >= lo) & (starts < hi)] - lo
        assert own[0] == 0 and (own % ATOM == 0).all()
        cost = BLOCK_COST * (x.max() - x.mean())
        error = sum(len(b) * b.max() - b.sum() + cost for b in np.split(x, own[1:]))
        assert error == pytest.approx(best_partition(x.tolist(), cost))


def test_blocks_skip_documents():
    """With a rare strong term most documents are never scored, and the result is that of scoring all."""
    rng = np.random.default_rng(5)
    n = 20_000
    common, rare = np.flatnonzero(rng.random(n) < 0.6), np.sort(rng.choice(n, 40, replace=False))
    doc, term = np.concatenate([common, rare]), np.concatenate([np.zeros(len(common), int), np.ones(len(rare), int)])
    score = np.concatenate([rng.integers(1, 50, len(common)), rng.integers(900, 1000, len(rare))])
    by = np.argsort(doc, kind="stable")
    shard = Shard(n, doc[by], term[by], score[by], 2)
    found, points = shard.best(np.array([0, 1]), 10, 0)
    total = np.bincount(doc, score, n).astype(int)
    want = np.lexsort((np.arange(n), -total))[:10]
    assert found.tolist() == want.tolist() and points.tolist() == total[want].tolist()
    assert shard.scored < 0.3 * np.count_nonzero(total)
