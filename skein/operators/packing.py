"""Greedy packing of ordered texts, as higher-order functions over arrays.

What is packed lies in one array, in order; the state that goes along it is a few
numbers and the places where groups begin, so nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import BLANK, let

FULL = 1 << 30  # the length of a group that takes nothing more


def group_starts(items: Column, size: Callable[[Column], Column], full: Callable[[Column, Column], Column], alone: Callable[[Column], Column] | None = None) -> Column:
    """Where groups of ``items`` begin, counted from 1.

    An item joins the open group, after one separator, unless ``full`` of the group's length and the item says otherwise.
    An item that stands ``alone`` is a group of its own.
    """

    def add(s: Column, x: Column) -> Column:
        lone = alone(x) if alone else F.lit(False)
        begins = (s["n"] == 0) | lone | full(s["length"], x)
        length = F.when(lone, F.lit(FULL)).when(begins, size(x)).otherwise(s["length"] + 1 + size(x))
        starts = F.when(begins, F.concat(s["starts"], F.array(s["n"] + 1))).otherwise(s["starts"])
        return F.struct(length.cast("int").alias("length"), (s["n"] + 1).alias("n"), starts.alias("starts"))

    start = F.struct(F.lit(0).alias("length"), F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("starts"))
    return F.aggregate(items, start, add, lambda s: s["starts"])


def grouped(items: Column, starts: Column) -> Column:
    """The items of each group, as an array of arrays."""
    end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(items) + 1)
    return F.transform(starts, lambda s, i: F.slice(items, s, end(i) - s))


def fitting(items: Column, room: int, separator: int) -> Column:
    """The first of ``items`` (texts) that fit into ``room`` characters together, a separator of that many between them."""
    sums = F.aggregate(
        items,
        F.struct(F.lit(-separator).alias("length"), F.lit(0).alias("n")),
        lambda s, x: let(s["length"] + separator + F.length(x), lambda n: F.struct(F.when(n > room, FULL).otherwise(n).alias("length"), (s["n"] + (n <= room).cast("int")).alias("n"))),
        lambda s: s["n"],
    )
    return F.slice(items, F.lit(1), sums)


def shortened(x: Column, most: int) -> Column:
    """A text of more than ``most`` characters, cut, with three dots at its end."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, most - 3), rf"{BLANK}+$", ""), F.lit("...")))
