"""Text kernel: stripping, tokenizers, sentence splitters and cleaning, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, with the separators U+001C to U+001F and U+0085.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
#: The same but for the plain blank.
UNEVEN = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}&&[^ ]]"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, evaluated once however often ``f`` uses it (branches of a CASE share nothing)."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def kept(keep: Callable[[Column], Column], *columns: Column) -> Column:
    """A generator of ``columns`` where ``keep`` of their struct holds: each is evaluated once, as a filter after them would be pushed below and repeat them."""
    return F.inline(F.filter(F.array(F.struct(*columns)), keep))


def strip(x: Column) -> Column:
    """Without white space of any script at both ends (trim() takes blanks only). Both ends are looked at first: the pattern goes over the whole text."""
    blank = lambda c: c.rlike(BLANK)
    cut = lambda x: F.when(blank(F.substring(x, 1, 1)) | blank(F.right(x, F.lit(1))), F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")).otherwise(x)
    return let(x, cut)


def word_tokens(x: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased; a run of CJK is one token."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Texts of ASCII and of ranges that hold nothing but letters: of Latin, Greek, Cyrillic and Han. It takes all from the start on; a search for the first of the others takes far longer.
SURE = r"\A[\x00-\x7F\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{3AC}-\x{3CE}\x{400}-\x{481}\x{4E00}-\x{9FEF}]*+\z"


def plain_or_tokens(x: Column) -> Column:
    """What ``word_tokens`` are made of, as a struct: ``plain``, the text in lower case, where all its bytes beyond ASCII are of letters
    (its tokens are found without the pattern then, A to Z may be left), else ``tokens``."""
    nothing = F.lit(None).cast("array<string>")
    plain = lambda t: F.struct(t.alias("plain"), nothing.alias("tokens"))
    cut = lambda x: F.struct(F.lit(None).cast("string").alias("plain"), word_tokens(x).alias("tokens"))
    wide = lambda x: let(F.lower(x), lambda t: F.when(t.rlike(SURE), plain(t)).otherwise(cut(x)))
    return let(x, lambda x: F.when(F.octet_length(x) == F.length(x), plain(x)).otherwise(wide(x)))


def lexical_tokens(x: Column) -> Column:
    """ASCII words, and single characters and pairs of CJK runs, lower-cased."""
    runs = F.regexp_extract_all(F.lower(x), F.lit("[一-鿿]+|[A-Za-z0-9]+"), F.lit(0))

    def parts(run: Column) -> Column:
        n = F.length(run)
        singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.when(run.rlike("^[一-鿿]"), F.concat(singles, pairs)).otherwise(F.array(run))

    return F.flatten(F.transform(runs, parts))


def token_set(x: Column) -> Column:
    return F.array_distinct(lexical_tokens(x))


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(x: Column) -> Column:
    """Parts that end in one of 。！？!?；; or at a line end; a full stop ends none."""
    return _trimmed(F.split(x, r"(?<=[。！？!?；;])|\n+"))


def prose_sentences(x: Column) -> Column:
    """Parts that end in . ! or ? before a capital, a digit or a quote, of text with single blanks."""
    return _trimmed(F.split(normalize_spaces(x), r"""(?<=[.!?])\s+(?=[A-Z0-9"'])"""))


def normalize_spaces(x: Column) -> Column:
    """Plain quotes and dashes, single blanks, none before , . ; : % ) or after (."""
    x = F.translate(x, "’“”–—", "'\"\"--")
    x = let(x, lambda x: F.when(x.rlike(rf"{UNEVEN}|  "), F.regexp_replace(x, rf"{BLANK}+", " ")).otherwise(x))
    x = F.regexp_replace(x, r" ([,.;:%)])", "$1")
    return strip(F.replace(x, F.lit("( "), F.lit("(")))


#: Cross references that are cut out of paragraphs, in this order (fixed values). The last starts where a sentence does:
#: it reaches left to the last full stop anyway, and other starts would be tried in vain.
CROSS_REFERENCES = (
    r"\s*(?:For (?:more|further|additional) information[^.]*,\s*)?refer to [^.]+(?:\.|$)",
    r"\s*For additional discussion[^.]*refer to [^.]+(?:\.|$)",
    r"\s*The following tables? (?:summarizes?|provides?|presents?|sets forth)[^.]+(?:\.|$)",
    r"\s*The table below [^.]+(?:\.|$)",
    r"\s*The following graph [^.]+(?:\.|$)",
    r"\s+provided in the following table",
    r"(?<![^.])\s*[^.]*\b(?:provided|reported|captured|presented)\s+in\s+(?:the\s+)?(?:table below|following table)[^.]*[.:]?",
)


#: What a text must hold (lower-cased) for each of these to match; without it the costly pattern isn't tried.
NEEDLES = ("refer to", "refer to", "the following table", "the table below", "the following graph", "following table", "table")


def _without(needle: str, pattern: str) -> Callable[[Column], Column]:
    return lambda t: F.when(F.contains(F.lower(t), F.lit(needle)), F.regexp_replace(t, pattern, "")).otherwise(t)


#: What one of NEEDLES holds at least.
ANY_NEEDLE = ("refer to", "the following graph", "table")


def clean_paragraph(x: Column) -> Column:
    """Text with single blanks and without cross references. Most texts hold no needle: their one look is all, as they have single blanks already."""

    def cut(x: Column) -> Column:
        for needle, pattern in zip(NEEDLES, CROSS_REFERENCES, strict=True):
            x = let(x, _without(needle, f"(?i){pattern}"))
        return normalize_spaces(x)

    def chosen(x: Column) -> Column:
        told = let(F.lower(x), lambda low: F.contains(low, F.lit(ANY_NEEDLE[0])) | F.contains(low, F.lit(ANY_NEEDLE[1])) | F.contains(low, F.lit(ANY_NEEDLE[2])))
        return F.when(told, cut(x)).otherwise(x)

    return let(normalize_spaces(x), chosen)


def count_words(x: Column) -> Column:
    return F.regexp_count(x, F.lit("[A-Za-z0-9]+"))


def strip_topic(x: Column, topic: Column) -> Column:
    """Without ``topic :`` at its start, in any case."""

    def cut(x: Column) -> Column:
        tail = F.substring(x, F.length(topic) + 1, F.length(x))
        has = F.lower(F.substring(x, F.lit(1), F.length(topic))).eqNullSafe(F.lower(topic)) & tail.rlike(r"^\s*:")
        return F.when(has, F.regexp_extract(tail, r"(?s)^\s*:\s*(.*)$", 1)).otherwise(x)

    return let(strip(x), cut)


def with_topic(x: Column, topic: Column) -> Column:
    """``topic: text`` with single blanks on each line, unless it starts so already."""
    clean = F.array_join(F.transform(F.split(x, "\n"), normalize_spaces), "\n")
    return let(clean, lambda c: F.when(F.startswith(F.lower(c), F.lower(topic)), c).otherwise(F.concat(topic, F.lit(": "), c)))


def join_topic(left: Column, right: Column, topic: Column) -> Column:
    return with_topic(F.concat(left, F.lit("\n"), strip_topic(right, topic)), topic)


def concise_title(topic: Column, title: Column) -> Column:
    x = F.when(strip(topic) != "", strip(topic)).otherwise(strip(title))
    x = F.regexp_replace(F.regexp_replace(x, rf"{BLANK}+", " "), r"^[ .:\-]+|[ .:\-]+$", "")
    return let(x, lambda t: F.when(F.length(t) <= 80, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, 77), rf"{BLANK}+$", ""), F.lit("..."))))
