"""Visible blocks of HTML: cases by hand, references against the standard library, and random tags against the recursive SQL."""

import html
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.operators import markup
from skein.plans.filing_oracles import ORACLES

PAGES = {
    "<p>a<p>b</p>c": [("a", False), ("b", False), ("c", False)],
    "</p></div>a</table><p>b": [("a", False), ("b", False)],  # ends of nothing close nothing
    "<div style='Display : none'><p>x</div>y</p></div>z": [("z", False)],  # any end closes what is open: </div> the paragraph, </p> the division
    "<div hidden=true>x<span>y</span></div>a<div hidden>b</div><i title='hidden=true'>c</i>": [("a", False), ("b", False), ("c", False)],
    "<table><tr><td>1<td>2</td><td>3</td></tr></table>a": [("1 2", True), ("3", True), ("a", False)],  # a start of <td> breaks no text; </table> ends the table though <td> is open
    "<table><tr><td>1</td></tr></table>a": [("1", True), ("a", False)],
    "<table><tr><td><table><tr><td>in</td></tr></table>still</td></tr></table>out": [("in", True), ("still", True), ("out", False)],
    "a<br/>b<br>c<hr>d<div/>e<td/>f": [("a", False), ("b", False), ("c", False), ("d", False), ("e", False), ("f", False)],
    "<script>if (a < b) '</p>'</script>x<style>p > q {}</style>y<!-- <p>no</p> -->z<!DOCTYPE html><?php ?>": [("x y z", False)],
    "<a title='1 > 0' href=\"x>y\">t</a> 2 < 3 <b": [("t 2 < 3 < b", False)],  # a tag that never ends is text
    "<head><title>no</title></head><body>yes": [("yes", False)],
    "x&nbsp;&amp;&lt;p&gt; &#65;&#x42; &copy &notit; &amp": [("x &<p> AB © ¬it; &", False)],
    "  <p> \n </p> ": [],
    "<script>never closed <p>x": [],
}


def blocks(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    out = {i: [] for i in range(len(pages))}
    for r in markup.html_blocks(df).orderBy("page_id", "ordinal").collect():
        out[r.page_id].append((r.text, r.in_table))
    return [out[i] for i in range(len(pages))]


def test_pages(spark):
    assert dict(zip(PAGES, blocks(spark, list(PAGES)), strict=True)) == {k: v for k, v in PAGES.items()}


def test_null_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a<p>b"), (3, "<p>a<p>b"), (None, "n")], "page_id long, html string")
    got = [(r.page_id, r.ordinal, r.text) for r in markup.html_blocks(df).collect()]
    assert sorted(got, key=str) == sorted([(3, 0, "a"), (3, 1, "b")] * 2 + [(None, 0, "n")], key=str)
    assert markup.html_blocks(df.limit(0)).count() == 0


def test_references(spark):
    cases = ["&amp;", "&ampx", "&AMP", "&notin;", "&notinx", "&#0;", "&#x80;", "&#150;", "&#xD800;", "&#x110000;", "&#x1F600;", "&#1;", "&#13;", "&#99999999999999;", "&", "&;", "a&b", "&#;", "&#x;", "&CounterClockwiseContourIntegral;", "&nosuchname;", "&frac12x", "&lt&gt", "100 & 200 &euro; x", "&#xfdd0;", "&#x0041"]
    rng = random.Random(3)
    cases += ["".join(rng.choice(["&", "#", "x", "amp", "lt", ";", "6", "5", "not", "in", " ", "copy", "é", "<"]) for _ in range(12)) for _ in range(200)]
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", markup.unescaped(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == {c: html.unescape(c) for c in cases}


def test_random_tags_equal_the_recursive_query(spark, tmp_path):
    rng = random.Random(5)
    bits = ["<p>", "</p>", "<div>", "</div>", "<div hidden='true'>", "<span style=\"display:none\">", "</span>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<br>", "<hr/>", "<img src='a>b'>", "<b>", "</b>", "text", "more &amp; text", " ", "<!-- c -->", "<script>x<p></script>", "<head>", "</head>", "<td/>", "</br>", "< 3"]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(700)]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    want = con.execute(ORACLES["html_blocks"]).fetchall()
    got = [tuple(r) for r in markup.html_blocks(spark.read.parquet(f"{tmp_path}/pages")).select("page_id", "ordinal", "text", "in_table").collect()]
    assert sorted(got) == sorted(want) and len(got) > 500


def test_one_shuffle_no_python(spark):
    df = spark.createDataFrame([(1, "<p>a")], "page_id long, html string")
    plan = markup.html_blocks(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


@pytest.mark.parametrize("n", [20_000])
def test_long_page(spark, n):
    """A page of many tokens and a long tag: no step depends on what a whole page holds at once."""
    page = "<div data-x='" + "y" * 100_000 + "'>" + "<p>word</p>" * n + "</div>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert markup.html_blocks(df).agg(F.count("*"), F.max("ordinal")).first()[:] == (n, n - 1)
