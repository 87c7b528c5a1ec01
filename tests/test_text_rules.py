import re

import pytest
from pyspark.sql import functions as F

from skein.functions import rules
from skein.functions import text as T


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


TEXTS = ["", " a ", "\t b　\n", " c\x1c", "Über Straße 12", "中文字 abc", "x" * 600, "a。b！c; d?\n\ne.f", "\U0001f600 é", "“q” – ( a , b ) : c"]


def test_strip(spark):
    assert column(spark, TEXTS, T.strip) == [t.strip() for t in TEXTS]


def test_word_tokens(spark):
    def spec(t):
        return "".join(c if c.isalnum() else " " for c in t.lower()).split()

    assert column(spark, TEXTS, T.word_tokens) == [spec(t) for t in TEXTS]


def test_lexical_tokens(spark):
    def spec(t):
        out = []
        for run in re.findall("[一-鿿]+|[A-Za-z0-9]+", t.lower()):
            out += [*run, *(run[i : i + 2] for i in range(len(run) - 1))] if "一" <= run[0] <= "鿿" else [run]
        return out

    assert column(spark, TEXTS, T.lexical_tokens) == [spec(t) for t in TEXTS]


def test_sentences(spark):
    assert column(spark, ["a。b！c; d?\n\ne.f", "", " \n "], T.sentences) == [["a。", "b！", "c;", "d?", "e.f"], [], []]
    assert column(spark, ['One. Two? "Three" four. five 6. 7'], T.prose_sentences) == [["One.", "Two?", '"Three" four. five 6.', "7"]]


def test_normalize_and_clean(spark):
    assert column(spark, ["“q” – ( a , b ) : c’s\t x"], T.normalize_spaces) == ["\"q\" - (a, b): c's x"]
    text = "Kept one. For more information on this, refer to page 5. Kept two. The following table presents x. As reported in the table below: y"
    assert column(spark, [text], T.clean_paragraph) == ["Kept one. Kept two."]


def test_topic_prefixes(spark):
    t = F.lit("Topic")
    assert column(spark, ["topic : x", "Topic x", "y", "Topical: z"], lambda x: T.strip_topic(x, t)) == ["x", "Topic x", "y", "Topical: z"]
    assert column(spark, ["TOPIC a", "b  c\nd ,"], lambda x: T.with_topic(x, t)) == ["TOPIC a", "Topic: b c\nd,"]
    assert column(spark, ["a", "Topic: b"], lambda x: T.join_topic(F.lit("Topic: l"), x, t)) == ["Topic: l\na", "Topic: l\nb"]
    assert column(spark, ["t" * 90, " .Short: "], lambda x: T.concise_title(x, F.lit("o"))) == ["t" * 77 + "...", "Short"]


@pytest.mark.parametrize(
    ("question", "kind"),
    [("What RISK?", "risk"), ("the subsidiary", "business"), ("its subsidiaries", "general"), ("cash flow", "performance"), ("liquidity risk", "risk"), ("", "general")],
)
def test_query_type(spark, question, kind):
    assert column(spark, [question], rules.query_type) == [kind]


def test_bonuses(spark):
    df = spark.createDataFrame(
        [("risk", rules.RISK, "financial_risk", "", "High"), ("business", rules.MDA, "x", "competition", "medium"), ("performance", rules.MDA, "performance_analysis", "", "low"), ("general", rules.BUSINESS, "", "", ""), ("performance", rules.RISK, "", "", "")],
        "k string, s string, p string, t string, q string",
    )
    got = df.select(rules.section_bonus(F.col("s"), F.col("k")), rules.topic_bonus(F.col("p"), F.col("t"), F.col("k")), rules.quality_bonus(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [(0.2, 0.1, 0.05), (0.1, 0.05, 0.02), (0.15, 0.1, 0.0), (0.15, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_skip_and_metric(spark):
    skipped = ["Part I", "12", "$1,2%", "x forward-looking statements", "Refer to Note 5", "The following table shows", "(a) item", "For more information, refer to x", "For a further discussion refer to y"]
    kept = ["1234x", "Refer to it", "For more information ask", "(A) item", "Text"]
    assert column(spark, skipped + kept, rules.skip_block) == [True] * len(skipped) + [False] * len(kept)
    assert column(spark, ["Net 5", "Page", "no digits here", "1 2 3 4 5 6"], rules.metric_row) == [True, True, False, False]


def test_headings(spark):
    rows = [
        ("Item 1. Business.", rules.BUSINESS, True), ("• point", rules.BUSINESS, False), ("Ends with:", rules.BUSINESS, True), ("Short line", rules.BUSINESS, True),
        ("Revenue 5", rules.BUSINESS, False), ("ALL UPPER CASE THAT IS LONGER THAN TWELVE WORDS SO THE SHORT RULE DOES NOT GET IT AT ALL", rules.MDA, True),
        ("The Firm may fail in some way that matters.", rules.RISK, True), ("The Firm may fail in some way that matters.", rules.MDA, False), ("", rules.RISK, False),
    ]
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(rows)], "i int, t string, s string")
    assert [r.h for r in df.select("i", rules.is_heading(F.col("t"), F.col("s")).alias("h")).orderBy("i").collect()] == [w for *_, w in rows]


def test_semantic_topic(spark):
    rows = [
        ("x", rules.BUSINESS, "the principal bank subsidiary", "Subsidiaries and operating structure"), ("Liquidity risk", rules.RISK, "", "Liquidity risk management"),
        ("t", rules.MDA, "our var rose", "Value-at-risk"), ("t", rules.BUSINESS, "various", "t"), ("Item 1. Business.", rules.BUSINESS, "", "Business overview"),
        ("t", rules.RISK, "cyber attacks", "Cybersecurity risk"), ("t", rules.RISK, "nothing", "Risk factor"), ("Net income was higher", rules.MDA, "", "Net income"),
        ("one two three four five six seven eight nine", rules.MDA, "", "one two three four five six seven"), (", x", rules.MDA, "", rules.MDA), ("Basel III", rules.MDA, "", "Regulatory capital requirements"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string, x string, want string")
    got = df.withColumn("got", rules.semantic_topic(F.col("t"), F.col("s"), F.col("x"))).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_taxonomy(spark):
    rows = [
        ("Competitive environment", rules.BUSINESS, "", ("competition", "competitive_environment")), ("Subsidiaries", rules.BUSINESS, "outside the U.S.", ("business_structure", "international_structure")),
        ("Other", rules.BUSINESS, "supervision of consumer", ("regulatory_risk", "consumer_finance_regulation")), ("Other", rules.BUSINESS, "", ("company_overview", "company_profile")),
        ("Credit", rules.RISK, "deposit", ("financial_risk", "funding_risk")), ("x", rules.RISK, "cyber", ("operational_risk", "cyber_risk")), ("x", rules.RISK, "", ("operational_risk", "operational_risk")),
        ("Revenue", rules.MDA, "", ("performance_analysis", "revenue_drivers")), ("Basel", rules.MDA, "", ("regulatory_risk", "capital_regulation")), ("x", rules.MDA, "", ("performance_analysis", "segment_performance")),
    ]
    df = spark.createDataFrame([(i, t, s, x) for i, (t, s, x, _) in enumerate(rows)], "i int, t string, s string, x string")
    got = df.select("i", rules.taxonomy(F.col("t"), F.lit(""), F.col("x"), F.col("s")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in got] == [w for *_, w in rows]


def test_quality(spark):
    df = spark.createDataFrame([(0, "text", "w " * 200), (1, "text", "w" * 400), (2, "text", "w" * 1501), (3, "text", "w" * 10), (4, "table_summary", "w" * 10), (5, "table_summary", "w" * 400)], "i int, k string, t string")
    assert [r.q for r in df.select("i", rules.quality_label(F.col("k"), F.col("t")).alias("q")).orderBy("i").collect()] == ["high", "medium", "low", "low", "medium", "high"]


def test_texts_without_cross_references_are_spaced_once(spark):
    """The costly patterns stand in a branch; a text that needs none comes out as the plain chain gives it."""
    import random

    rng = random.Random(8)
    bits = ["a", "b", " ", "  ", "\t", "\xa0", "\u2003", "\x1c", "(", "( ", ")", " ,", ".", "’", "–", "table", "refer to x.", "The table below is y.", "\n", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(1500)] + [None, "", " "]
    blank = T.BLANK
    plain_strip = lambda x: F.regexp_replace(x, rf"^{blank}+|{blank}+$", "")

    def plain(x):
        x = F.regexp_replace(F.translate(x, "’“”–—", "'\"\"--"), rf"{blank}+", " ")
        return plain_strip(F.regexp_replace(F.regexp_replace(x, r" ([,.;:%)])", "$1"), r"\( ", "("))

    def cleaned(x):
        x = plain(x)
        for pattern in T.CROSS_REFERENCES:
            x = F.regexp_replace(x, f"(?i){pattern}", "")
        return plain(x)

    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select("t", T.strip(t).alias("s"), plain_strip(t).alias("s2"), T.normalize_spaces(t).alias("n"), plain(t).alias("n2"), T.clean_paragraph(t).alias("c"), cleaned(t).alias("c2")).collect()
    assert all((r.s, r.n, r.c) == (r.s2, r.n2, r.c2) for r in got)
    assert not any(n not in " ".join(T.NEEDLES) for n in T.ANY_NEEDLE) and all(any(a in n for a in T.ANY_NEEDLE) for n in T.NEEDLES)
