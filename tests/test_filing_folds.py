"""Chunks of made-up filings against the recursive SQL: other texts than the driver's, with every rule at work."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.plans import queries
from skein.plans.filing_oracles import ORACLES

WORDS = "operations worldwide market risk credit capital the firm and its net income was up liquidity competition data cyber of to in for by with employees".split()
HEADINGS = ("Overview", "Competition:", "Risk factors", "CREDIT RISK", "The Firm may suffer losses.", "Overview", "Item 7. Liquidity risk management.")
ODD = ("Part I", "12", "$ 5.0", "refer to note 3", "• point", "The following table presents it.", "$", "%", "a", "• ", "Page")


def made_text(rng: random.Random) -> str:
    lines = []
    for _ in range(rng.randrange(1, 70)):
        kind = rng.random()
        if kind < 0.15:
            lines.append(rng.choice(HEADINGS))
        elif kind < 0.3:
            lines.append(rng.choice(ODD))
        else:
            n = rng.choice((3, 8, 40, 90, 260, 420))
            said = " ".join(rng.choice(WORDS) for _ in range(n))
            lines.append(". ".join(p.capitalize() for p in said.split(" the ")) + ".")
    return "\n".join(lines)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(7), tmp_path_factory.mktemp("filings")
    rows = [(i, made_text(rng), "en", "s", 0) for i in range(60)]
    rows += [(60, None, "en", "s", 0), (61, "", "en", "s", 0), (62, "\n\n", "en", "s", 0)]
    rows += [(63, "\n".join(["One long sentence without an end " + "word " * 500, "x" * 1700]), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["section_chunks", "filing_chunks"])
def test_folds_equal_the_recursive_query(spark, tables, name):
    got = queries.QUERIES[name](spark, tables)
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tables}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want)) and len(rows) > 100


def test_folds_stay_in_the_jvm(spark, tables):
    plan = queries.QUERIES["filing_chunks"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_a_section_is_shuffled_once(spark, tables):
    """All that section_chunks does groups within the sections that its one shuffle gathers."""
    plan = queries.QUERIES["section_chunks"](spark, tables).select(F.col("doc"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(doc") == 1


def test_sections_in_one_pass_are_those_of_their_bounds(spark):
    """Against the bounds one by one: missing starts and ends, repeated headings, sections that overlap."""
    from skein.operators import filing

    rng = random.Random(9)
    lines = ["Item 1. Business.", "Item 1A. Risk Factors.", "Item 1B. Unresolved Staff Comments.", filing.MDA_HEADING, filing.MDA_OPENING + " of it", filing.MDA_END, "text", "more"]
    rows = [(d, i, rng.choice(lines), False) for d in range(150) for i in sorted(rng.sample(range(60), rng.randrange(0, 25)))]
    blocks = spark.createDataFrame(rows, "doc int, ordinal int, text string, in_table boolean")
    first = filing.section_bounds(blocks, filing.BUSINESS_START, filing.RISK_START)
    after = first.where("end_ordinal is not null").select("doc", F.col("end_ordinal").alias("after"))
    risk = filing.section_bounds(blocks, filing.RISK_START, filing.RISK_END, after=after)
    mda = filing.discussion_bounds(blocks, filing.MDA_HEADING, filing.MDA_OPENING, filing.MDA_END)
    want = set()
    for name, bounds in zip((s.name for s in filing.FILING_SECTIONS), (first, risk, mda), strict=True):
        for b in bounds.where("end_ordinal is not null").collect():
            want |= {(b.doc, name, o, t) for d, o, t, _ in rows if d == b.doc and b.start_ordinal <= o < b.end_ordinal}
    out = filing.sectioned(blocks)
    plan = out._jdf.queryExecution().executedPlan().toString()  # before it runs, and changes
    assert {(r.doc, r.section, r.ordinal, r.text) for r in out.collect()} == want and out.count() == len(want) > 100
    assert plan.count("Exchange hash") == 1 and "Join" not in plan
    with pytest.raises(ValueError, match="could not find"):
        filing.sectioned(blocks, strict=True)
