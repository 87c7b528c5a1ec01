"""Secret scans over an incremental, content-addressed blob ledger.

Every version of a document is a path (its doc_id) to a blob, addressed by the
SHA-256 of its text. A rule has a version, the hash of its definition. The ledger
is a table of (blob, rule_version, spans) of all pairs scanned so far; a scan
takes the distinct blobs of the versions it is given, drops the pairs that the
ledger holds, scans only the rest, and joins the findings back to all paths.
``scan_blobs`` gives the new ledger rows, ``scan`` the findings of all versions.

All of it is DataFrame and SQL functions. Offsets of matches come from splitting a
text by the pattern: the pieces between matches and the matches alternate, and
running sums of their lengths (in code points) are the offsets. Patterns whose
failing matches are long runs are written with the least length inside the
pattern, where that finds exactly the same matches; the assignment rule isn't, as
a shorter match would otherwise be tried again from within.

Blobs are de-duplicated before anything is scanned, with a partial aggregate on
each task, so thousands of copies cost one scan and no task gathers them. Null
texts count as empty; empty texts have no findings. Repeated rows keep one result
each. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.storage import Scratch


@dataclass(frozen=True)
class Rule:
    """kind, the pattern, a cheap pattern that every text with a match contains, and the least length of ``group``."""

    kind: str
    pattern: str
    hint: str
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


_NAMES = r"(password|passwd|secret|token|api_?key)"
RULES = (
    Rule("assign", r"(?i:" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:" + _NAMES + r""")["']?\x20*[:=]""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", r"AKIA"),  # AKIA[A-Z0-9]+ of 16 characters or more
    Rule("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),  # [0-9a-f]+ of 32 characters or more
)
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Array of (start, rank, kind, end) of the rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    keep = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else found
    lengths = F.arrays_zip(pieces.alias("gap"), F.transform(found, F.length).alias("len"), F.transform(keep, F.length).alias("kept"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (begin + x["len"]).alias("end"))
        good = x["len"].isNotNull() & (x["kept"] >= rule.least)
        return F.struct(
            (begin + F.coalesce(x["len"], F.lit(0))).alias("at"),
            F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    every = F.aggregate(lengths, start, step, lambda a: a["spans"])
    return F.when(F.contains(text, F.lit(rule.hint)) if rule.hint.isalnum() else text.rlike(rule.hint), every).otherwise(F.expr(f"cast(array() as {SPAN})"))


def scan_blobs(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, rule_version, spans) for the unseen pairs of ``versions`` (blob, text); pairs without findings too."""
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    want = [(r.version, i) for i, r in enumerate(rules)]
    if ledger is None:
        todo = F.lit(True)
        seen = blobs
    else:
        old = ledger.where(F.col("rule_version").isin([v for v, _ in want])).groupBy("blob").agg(F.collect_set("rule_version").alias("__done"))
        seen = blobs.join(old, "blob", "left")
    parts = []
    for version, i in want:
        todo = F.lit(True) if ledger is None else ~F.coalesce(F.array_contains("__done", version), F.lit(False))
        parts.append(F.when(todo, F.struct(F.lit(version).alias("rule_version"), spans_of(F.col("text"), rules[i], i).alias("spans"))))
    return seen.select("blob", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("f")).select("blob", "f.rule_version", "f.spans")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each version: doc_id, blob, found (its spans by start, then rule). Only pairs new to ``ledger`` are scanned."""
    body = F.coalesce(F.col(text), F.lit(""))
    versions = docs.select(F.col(key).alias("doc_id"), F.sha2(body, 256).alias("blob"), body.alias("text"))
    # Written as rows of the ledger: read back, the few findings join as a table of their own, and many paths of one blob can be split.
    new = Scratch(docs.sparkSession).save(scan_blobs(versions, rules, ledger), "ledger")
    rows = new if ledger is None else new.unionByName(ledger.where(F.col("rule_version").isin([r.version for r in rules])).select("blob", "rule_version", "spans"))
    found = rows.where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
    return versions.select("doc_id", "blob").join(found, "blob", "left").withColumn("found", F.coalesce("found", F.expr(f"cast(array() as {SPAN})")))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by kind, spans as text and their hash, for each row of ``scan``."""
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[n(r.kind).alias(f"n_{r.kind}") for r in rules], F.sha2(as_text(F.col("found")), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans")
    )
