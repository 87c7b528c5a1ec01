import random
import re

import pytest

from skein.llm import suffix_dedup


def brute(rows):
    seen, words = {}, []
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        words.append((d, w))
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(d)
    out = set()
    for d, w in words:
        spans = []
        for i in range(len(w) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 50
                else:
                    spans.append([i, i + 50])
        out |= {(d, a, b) for a, b in spans}
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shared = [words(n) for n in (50, 51, 60, 75, 140, 49, 30)]
    rows = []
    for i in range(40):
        text = words(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(shared)
            a = rng.choice([0, 0, 0, rng.randrange(len(p) // 2)])
            b = rng.choice([len(p), len(p), rng.randrange(len(p) // 2, len(p))])
            text += p[a:b] + words(rng.randrange(0, 30))
        rows.append((i, " ".join(text)))
    rows += [(100, rows[3][1]), (101, rows[3][1].upper()), (102, None), (103, ""), (104, "la " * 300), (105, "x " + "la " * 120), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 3), (3, 20_000)])
def test_matches_brute_force(spark, seed, hot):
    rows = corpus(seed)
    got = suffix_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot=hot).collect()
    assert sorted(((r.doc_id, r.start_word, r.end_word) for r in got), key=str) == brute(rows)
    assert all(r.n_words == r.end_word - r.start_word and r.other_doc != r.doc_id for r in got)


def test_empty_null_ids_and_clashing_names(spark):
    schema = "doc_id long, text string, key int, shard int"
    assert suffix_dedup.passages(spark.createDataFrame([], schema)).collect() == []
    text = " ".join(f"a{i}" for i in range(60))
    got = suffix_dedup.passages(spark.createDataFrame([(None, text, 1, 1), (None, text, 1, 1), (7, "b " + text, 1, 1)], schema)).collect()
    assert sorted((str(r.doc_id), r.start_word, r.end_word, str(r.other_doc)) for r in got) == [("7", 1, 61, "None"), ("None", 0, 60, "7")]


def test_very_long_text(spark):
    text = " ".join(f"t{i}" for i in range(200_000))
    got = suffix_dedup.passages(spark.createDataFrame([(1, text), (2, "start " + text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == [(1, 0, 200_000), (2, 1, 200_001)]


def others(rows):
    """For each passage of the brute force, the smallest document with a stretch of it, or the largest for that one itself."""
    seen, words = {}, {}
    for d, text in rows:
        words.setdefault(d, []).append(re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()))
        for i in range(len(words[d][-1]) - 49):
            seen.setdefault(tuple(words[d][-1][i : i + 50]), set()).add(d)
    out = {}
    for d, a, b in brute(rows):
        for w in words[d]:
            shared = [seen[tuple(w[i : i + 50])] for i in range(a, min(b, len(w)) - 49) if len(seen[tuple(w[i : i + 50])]) > 1]
            if shared and len(w) >= b:
                out[d, a, b] = (min(map(min, shared)), max(map(max, shared)))
    return {k: lo if lo != k[0] else hi for k, (lo, hi) in out.items()}


@pytest.mark.parametrize(("seed", "hot"), [(4, 20_000), (5, 1)])
def test_other_document(spark, seed, hot):
    rows = corpus(seed)[:-1]  # without the second text of document 3
    got = suffix_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=hot).collect()
    assert {(r.doc_id, r.start_word, r.end_word): r.other_doc for r in got} == others(rows)


@pytest.mark.parametrize("hot", [20_000, 20])
def test_common_passage_amid_different_texts_and_many_copies(spark, hot):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    common, copied = words(60), words(90)
    rows = [(i, f"{words(rng.randrange(40))} {common} {words(rng.randrange(40))}") for i in range(120)] + [(1000 + i, copied) for i in range(150)]
    got = suffix_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot).collect()
    assert sorted(((r.doc_id, r.start_word, r.end_word) for r in got), key=str) == brute(rows)
    assert {(r.doc_id, r.start_word, r.end_word): r.other_doc for r in got} == others(rows)


def test_long_passage_of_one_word(spark):
    rows = [(1, "la " * 400), (2, "x " + "la " * 60), (3, "la " * 49), (4, "y " * 120 + "la " * 50)]
    got = suffix_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.start_word, r.end_word) for r in got), key=str) == brute(rows)
