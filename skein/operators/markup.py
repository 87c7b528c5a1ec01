"""Blocks of visible text of HTML, by sums over tokens.

A page is cut into tokens (text, tags, whole scripts and styles, comments) by one
pattern. All that a reader of HTML remembers is then a running sum over the tokens of a page:

- The depth of open elements is the sum of starts and ends, less its own lowest value
  below zero (an end with nothing open closes nothing).
- An end closes the start before it on its level; elements whose start hides them
  count while they are open, and what is seen has none of them around it.
- Open tables are counted as the depth is; the number of a block is the count of seen
  tags that break text before it.

So one shuffle by page and sorts within it do the work, whatever the size of a page, and
nothing leaves the JVM. Tags that never have an end (br, meta, ...) open nothing, and ends close
whatever is open, as most readers of broken pages take it.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import kept, let, normalize_spaces, strip

# Tags by what they do (fixed values).
BREAKING = tuple("div p tr li br hr".split())
ENDING = (*BREAKING, "td", "th")
UNSEEN = ("head", "script", "style")
VOID = tuple("area base br col embed hr img input link meta source track wbr".split())

_INSIDE = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
TOKEN = rf"(?is)<!--.*?(?:-->|\z)|<script\b{_INSIDE}>.*?(?:</script\b[^>]*>|\z)|<style\b{_INSIDE}>.*?(?:</style\b[^>]*>|\z)|</?[a-z]{_INSIDE}>|<[!?/][^>]*>|[^<]+|<"
ATTRIBUTE = r"""([^\s/>="']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
CHARACTER = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
#: Numbers of Windows-1252 that stand for its characters, the others of their range for themselves.
_WINDOWS = {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
_LONGEST = max(len(n) for n in html5 if not n.endswith(";"))


def _lookup(table: dict[str, str]) -> Column:
    """A map as one literal."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))


def _numbered(piece: Column) -> Column:
    """The character of a numeric reference; null if it is none."""
    hexadecimal = F.regexp_extract(piece, r"^&#[xX]0*([0-9a-fA-F]+);?$", 1)
    decimal = F.regexp_extract(piece, r"^&#0*([0-9]+);?$", 1)
    number = F.when(hexadecimal != "", F.when(F.length(hexadecimal) > 6, F.lit(1 << 30)).otherwise(F.conv(hexadecimal, 16, 10).cast("long"))).when(decimal != "", F.when(F.length(decimal) > 7, F.lit(1 << 30)).otherwise(decimal.cast("long")))

    def character(n: Column) -> Column:
        none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE).cast("long")) == 0xFFFE)
        text = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        windows = F.try_element_at(_lookup({str(k): v for k, v in _WINDOWS.items()}), n.cast("string"))
        return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(n.between(0x80, 0x9F), windows).when(none, "").otherwise(text)

    return let(number, lambda n: F.when(n.isNotNull(), character(n)))


def _named(piece: Column) -> Column:
    """The character of a named reference, or of the longest name without a semicolon that it begins with; null if it is none."""
    name = F.substring(piece, 2, 40)
    whole = F.try_element_at(_lookup(html5), name)
    plain = {n: c for n, c in html5.items() if not n.endswith(";")}
    ahead = lambda m: [F.concat(F.try_element_at(m, F.substring(name, 1, k)), F.substring(name, k + 1, 40)) for k in range(_LONGEST, 1, -1)]
    return F.coalesce(whole, let(_lookup(plain), lambda m: F.coalesce(*ahead(m))))


def unescaped(x: Column) -> Column:
    """Text with its character references replaced."""

    def one(piece: Column) -> Column:
        common = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0", "&#160;": "\xa0"}
        out = F.when(~F.startswith(piece, F.lit("&")) | (piece == "&"), piece)
        for name, c in common.items():
            out = out.when(piece == name, c)
        return out.when(F.startswith(piece, F.lit("&#")), F.coalesce(_numbered(piece), piece)).otherwise(F.coalesce(_named(piece), piece))

    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(x, F.lit(CHARACTER), F.lit(0)), one), "")).otherwise(x)


def _value(tag: Column, name: str) -> Column:
    """The last value of an attribute of a tag, small letters, references in it as they stand; empty if there is none."""
    both = F.arrays_zip(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1)).alias("name"), F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2)).alias("value"))
    own = F.filter(both, lambda a: F.lower(a["name"]) == name)
    value = F.regexp_replace(F.try_element_at(own, F.lit(-1))["value"], "^[\"']|[\"']$", "")
    return F.coalesce(F.lower(value), F.lit(""))


def _hides(tag: Column, name: Column) -> Column:
    told = F.contains(F.lower(tag), F.lit("hidden")) | F.contains(F.lower(tag), F.lit("style"))
    said = _value(tag, "hidden").isin("hidden", "true") | F.contains(F.replace(_value(tag, "style"), F.lit(" "), F.lit("")), F.lit("display:none"))
    return name.isin(*UNSEEN) | F.when(told, said).otherwise(F.lit(False))


def tokens(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(row, key, at, text, name, opens, closes, hides) of all tokens but comments, scripts and styles.

    ``text`` is null for tags, ``name`` for text; a tag that closes itself opens and closes.
    """

    def parsed(token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
        ends, text = F.startswith(token, F.lit("</")), ~token.rlike(r"^<[A-Za-z/!?]")
        return let(
            F.struct(F.when(~text & (name != ""), name).alias("name"), ends.alias("ends"), text.alias("is_text")),
            lambda t: F.struct(
                F.when(t["is_text"], token).alias("text"),
                t["name"].alias("name"),
                (t["name"].isNotNull() & ~t["ends"]).alias("opens"),
                (t["name"].isNotNull() & (t["ends"] | F.endswith(token, F.lit("/>")))).alias("closes"),
                (t["name"].isNotNull() & ~t["ends"] & _hides(token, t["name"])).alias("hides"),
            ),
        )

    whole = F.filter(F.regexp_extract_all(F.col(html), F.lit(TOKEN), F.lit(0)), lambda t: ~t.rlike(r"(?i)^<(?:!|\?|script\b|style\b)"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), key, html)  # before tokens are made, or each would get a number
    rows = rows.select("row", key, F.posexplode(whole).alias("at", "token"))
    return rows.select("row", key, "at", F.inline(F.array(parsed(F.col("token")))))


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ordinal, text, in_table) of all visible blocks. Null and empty pages have none; repeated rows have theirs each."""
    page = Window.partitionBy("row").orderBy("at")
    here = page.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    void = F.col("name").isin(*VOID)
    x = tokens(pages, key, html).withColumn("step", F.when(F.col("name").isNull() | void | (F.col("opens") & F.col("closes")), 0).when(F.col("opens"), 1).otherwise(-1))
    x = x.withColumn("sum", F.sum("step").over(here)).withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(here)))
    # The level that a tag opens or closes; an end without a start has none.
    level = F.when(F.col("step") == 1, F.col("depth")).when(F.col("step") == -1, F.nullif(F.lag("depth", 1, 0).over(page), F.lit(0)))
    x = x.withColumn("level", level)
    hid = F.lag("hides").over(Window.partitionBy("row", "level").orderBy("at"))
    x = x.withColumn("turn", F.when(F.col("level").isNull(), 0).when(F.col("step") == 1, F.col("hides").cast("int")).otherwise(-hid.cast("int")))
    x = x.withColumn("hidden", F.sum("turn").over(here))
    # An end is seen or not as what it closes is.
    seen = (F.when(F.col("step") == -1, F.col("hidden") - F.col("turn")).otherwise(F.col("hidden")) == 0) & ~F.when(F.col("step") == 1, F.lit(False)).otherwise(F.col("hides"))
    x = x.withColumn("seen", seen)
    breaks = F.col("seen") & ((F.col("opens") & F.col("name").isin(*BREAKING)) | (F.col("closes") & ~void & F.col("name").isin(*ENDING)))
    x = x.withColumn("block", F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(here))
    x = x.withColumn("tables", F.sum(F.when(F.col("seen") & (F.col("name") == "table"), F.col("step")).otherwise(0)).over(here))
    x = x.withColumn("tables", F.col("tables") - F.least(F.lit(0), F.min("tables").over(here)))
    said = F.when(F.col("seen") & F.col("text").isNotNull(), F.translate(unescaped(F.col("text")), "\xa0", " "))
    x = x.select("row", key, "at", "block", (F.col("tables") > 0).alias("in_table"), kept(lambda c: strip(c["said"]) != "", said.alias("said")))
    raw = x.groupBy("row", key, "block").agg(F.sort_array(F.collect_list(F.struct("at", "said"))).alias("parts"), F.max("in_table").alias("in_table"))
    raw = raw.withColumn("ordinal", F.row_number().over(Window.partitionBy("row").orderBy("block")) - 1)
    text = F.array_join(F.transform("parts", lambda p: p["said"]), " ")
    return raw.select(key, "ordinal", kept(lambda c: c["text"] != "", normalize_spaces(text).alias("text")), "in_table")
