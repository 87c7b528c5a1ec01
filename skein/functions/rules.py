"""Keyword rules: ordered first-match tables that become CASE expressions.

Needles are substrings, not words, and the order decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import BLANK, count_words, let, strip

BUSINESS, RISK, MDA = "Item 1 Business", "Item 1A Risk Factors", "Item 7 MD&A"
SECTIONS = (BUSINESS, RISK, MDA)
SECTION_KEYS = {BUSINESS: "item1", RISK: "item1a", MDA: "item7"}


def has_any(x: Column, needles: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(n)) for n in needles])


def first_match(x: Column, rules: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """The value of the first rule whose needle ``x`` contains."""

    def pick(x: Column) -> Column:
        (needle, value), *rest = rules
        out = F.when(F.contains(x, F.lit(needle)), value)
        for needle, value in rest:
            out = out.when(F.contains(x, F.lit(needle)), value)
        return out.otherwise(otherwise)

    return let(x, pick)


def first_group(x: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The name of the first group of which ``x`` contains a needle."""

    def pick(x: Column) -> Column:
        (name, needles), *rest = rules
        out = F.when(has_any(x, needles), name)
        for name, needles in rest:
            out = out.when(has_any(x, needles), name)
        return out.otherwise(otherwise)

    return let(x, pick)


# --- Questions. Kinds of question with their needles, sections and topics. ---
QUERY_NEEDLES = (
    ("risk", ("risk", "regulation", "compliance", "litigation")),
    ("business", ("segment", "business", "subsidiary", "competitive", "competition")),
    ("performance", ("revenue", "expense", "balance", "cash flow", "liquidity")),
)
QUERY_SECTIONS = {"risk": (RISK, MDA), "business": (BUSINESS,), "performance": (MDA,), "general": (MDA, BUSINESS, RISK)}
QUERY_TOPICS = {
    "risk": ("regulatory_risk", "financial_risk"),
    "business": ("business_segment", "company_overview", "competition"),
    "performance": ("performance_analysis",),
    "general": (),
}
SECTION_WEIGHTS = {"risk": {RISK: 0.20, MDA: 0.15, BUSINESS: 0.05}, "business": {BUSINESS: 0.20, MDA: 0.10, RISK: 0.05}}
OTHER_SECTION_WEIGHT = 0.15
PRIMARY_TOPIC_BONUS, SECONDARY_TOPIC_BONUS = 0.10, 0.05
QUALITY_BONUS = {"high": 0.05, "medium": 0.02}
SCORE_WEIGHTS = (0.70, 0.15, 0.10, 0.05)  # embedding, section, topic, quality


def query_type(question: Column) -> Column:
    return first_group(F.lower(question), QUERY_NEEDLES, "general")


def _by_type(kind: Column, table: dict[str, Sequence[str]]) -> Column:
    lists = {k: F.array(*[F.lit(x) for x in v]) if v else F.expr("cast(array() as array<string>)") for k, v in table.items()}
    out = F.when(kind == "risk", lists["risk"])
    for k in ("business", "performance"):
        out = out.when(kind == k, lists[k])
    return out.otherwise(lists["general"])


def query_sections(kind: Column) -> Column:
    return _by_type(kind, QUERY_SECTIONS)


def query_topics(kind: Column) -> Column:
    return _by_type(kind, QUERY_TOPICS)


def section_bonus(section: Column, kind: Column) -> Column:
    def table(weights: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for name, w in weights.items():
            out = F.when(section == name, w).otherwise(out)
        return out

    rest = F.when(F.array_contains(query_sections(kind), section), OTHER_SECTION_WEIGHT).otherwise(0.0)
    return F.when(kind == "risk", table(SECTION_WEIGHTS["risk"])).when(kind == "business", table(SECTION_WEIGHTS["business"])).otherwise(rest)


def topic_bonus(primary: Column, secondary: Column, kind: Column) -> Column:
    topics = query_topics(kind)
    return F.when(F.array_contains(topics, primary), PRIMARY_TOPIC_BONUS).otherwise(0.0) + F.when(F.array_contains(topics, secondary), SECONDARY_TOPIC_BONUS).otherwise(0.0)


def quality_bonus(quality: Column) -> Column:
    q = F.lower(quality)
    return F.when(q == "high", QUALITY_BONUS["high"]).when(q == "medium", QUALITY_BONUS["medium"]).otherwise(0.0)


# --- Words of a question that say nothing (fixed values). ---
STOP_WORDS = (
    "a", "about", "and", "are", "as", "at", "chase", "describe", "does", "for", "how", "in", "is", "its", "jpmorgan", "main", "of", "or",
    "say", "says", "the", "to", "what", "with",
)

# --- Categories of articles; case-sensitive needles (fixed values). ---
ARTICLE_CATEGORIES = (
    ("macro", ("非农", "就业", "美联储", "降准", "降息", "通胀", "财政", "pmi", "gdp")),
    ("commodity", ("原油", "布伦特", "黄金", "天然气", "油价", "LNG", "霍尔木兹")),
    ("banking", ("银行", "农行", "工行", "建行", "中行", "贷款", "担保", "融资")),
    ("equity", ("A50", "阿里巴巴", "百度", "台积电", "特斯拉", "英伟达", "亚马逊")),
    ("policy", ("人大", "政协", "双城记", "金融赋能", "监管", "ipo", "审核", "证监会", "央行")),
    ("company", ("营收", "巨亏", "增长", "业绩", "指引", "工厂", "订单", "需求", "市场业务")),
)


def article_category(title: Column, text: Column) -> Column:
    return first_group(F.concat(title, F.lit("\n"), text), ARTICLE_CATEGORIES, "general")


# --- Blocks of a filing. What marks boilerplate, headings and rows of figures. ---
SKIP_EXACT = ("", "Part I", "Table of contents")
SKIP_CONTAINS = (
    "JPMorgan Chase & Co./2025 Form 10-K",
    "makes available on its website",
    "provided in the Management's discussion",
    "is included in both JPMorganChase's Annual Report",
    "does not contain all of the information",
    "should be read in its entirety",
)
SKIP_CONTAINS_LOWER = ("information provided below", "forward-looking statements", "private securities litigation reform act", "readers should not consider")
SKIP_STARTS_LOWER = ("for additional information, refer to", "the following table", "in the following table", "in the following tables")
SKIP_STARTS_IF_REFERS = ("for more information", "for a further discussion")
METRIC_LABELS = (
    "Year ended December 31,",
    "Selected income statement data",
    "Selected ratios and metrics",
    "As of or for the year ended December 31,",
    "Page",
)
RISK_STARTERS = ("JPMorganChase", "The Firm", "The financial", "Unfavorable", "A reduction", "A failure", "Damage", "Employee", "An outbreak", "The laws")


def skip_block(x: Column) -> Column:
    """Whether a block is boilerplate."""
    return let(x, _skip)


def _skip(x: Column) -> Column:
    low = F.lower(x)
    tests = [x.isin(*SKIP_EXACT), x.rlike(r"^\d{1,3}$"), x.rlike(r"^[$%()\-.,\d]+$"), has_any(x, SKIP_CONTAINS), has_any(low, SKIP_CONTAINS_LOWER)]
    tests.append(F.startswith(low, F.lit("refer to ")) & x.rlike(r"(?i)\bpages?\b|\bnote\b"))
    tests += [F.startswith(low, F.lit(s)) for s in SKIP_STARTS_LOWER]
    tests += [F.startswith(low, F.lit(s)) & F.contains(low, F.lit("refer to")) for s in SKIP_STARTS_IF_REFERS]
    tests.append(x.rlike(r"^\([a-z]\)\s"))
    return reduce(lambda a, b: a | b, tests)


def metric_row(x: Column) -> Column:
    return (x.rlike(r"\d") & (count_words(x) <= 5)) | x.isin(*METRIC_LABELS)


def is_heading(x: Column, section: Column) -> Column:
    """Whether a block is a heading; the short-line rule decides alone where it applies."""
    return let(x, lambda x: _heading(x, section))


def _heading(x: Column, section: Column) -> Column:
    n, words = F.length(x), count_words(x)
    short = (n <= 95) & ~F.endswith(x, F.lit(".")) & (words <= 12)
    upper = x.rlike(r"\p{L}") & (F.upper(x) == x)
    risk = (n <= 220) & F.endswith(x, F.lit(".")) & (words <= 28) & reduce(lambda a, b: a | b, [F.startswith(x, F.lit(s)) for s in RISK_STARTERS])
    return (
        F.when((x == "") | F.startswith(x, F.lit("• ")), False)
        .when(x.rlike(r"^Item\s+\d+[A-Z]?\..*$"), True)
        .when(F.endswith(x, F.lit(":")) & (n <= 140), True)
        .when(short, ~metric_row(x))
        .when(upper & (n <= 120), True)
        .when(section == RISK, risk)
        .otherwise(False)
    )


# --- Topics of filing chunks (fixed values). ---
PRIORITY_TOPICS = (
    ("principal bank subsidiary", "Subsidiaries and operating structure"),
    ("liquidity risk", "Liquidity risk management"),
    ("jpmse", "Regulatory capital for subsidiaries"),
    ("j.p. morgan se", "Regulatory capital for subsidiaries"),
    ("j.p. morgan securities plc", "Regulatory capital for subsidiaries"),
)
TOPIC_RULES = (
    ("principal bank subsidiary", "Subsidiaries and operating structure"),
    ("operations worldwide", "Firm business overview"),
    ("business segments", "Business segments"),
    ("competition", "Competitive environment"),
    ("supervision and regulation", "Regulatory environment"),
    ("financial holding company", "Financial holding company regulation"),
    ("subsidiary banks", "Bank subsidiary regulation"),
    ("securities and broker-dealer", "Broker-dealer regulation"),
    ("investment management regulation", "Investment management regulation"),
    ("derivatives regulation", "Derivatives regulation"),
    ("data, privacy, cybersecurity", "Data and cybersecurity regulation"),
    ("bank secrecy act", "Financial crimes compliance"),
    ("anti-corruption", "Anti-corruption compliance"),
    ("compensation practices", "Compensation governance"),
    ("sustainability", "Sustainability regulation"),
    ("human capital", "Human capital strategy"),
    ("global workforce", "Workforce profile"),
    ("attracting and retaining", "Talent attraction and retention"),
    ("developing employees", "Employee development"),
    ("rewarding and supporting", "Employee compensation and benefits"),
    ("executive overview", "Financial performance overview"),
    ("consolidated results", "Consolidated financial performance"),
    ("balance sheets", "Balance sheet and cash flow trends"),
    ("non-gaap", "Non-GAAP financial measures"),
    ("consumer & community banking", "Consumer banking performance"),
    ("commercial & investment bank", "Commercial and investment banking performance"),
    ("asset & wealth management", "Asset and wealth management performance"),
    ("treasury and cio", "Treasury and CIO activities"),
    ("firmwide risk management", "Firmwide risk management"),
    ("three lines of defense", "Risk governance model"),
    ("risk governance", "Risk governance"),
    ("risk identification", "Risk ownership"),
    ("board oversight", "Board risk oversight"),
    ("management oversight", "Management risk oversight"),
    ("risk appetite", "Risk appetite"),
    ("strategic risk", "Strategic risk management"),
    ("capital risk", "Capital risk management"),
    ("stress capital buffer", "Capital stress testing"),
    ("comprehensive capital analysis", "Capital stress testing"),
    ("basel iii", "Regulatory capital requirements"),
    ("total loss-absorbing capacity", "Loss-absorbing capital requirements"),
    ("preferred stock", "Preferred stock capital actions"),
    ("common stock dividends", "Common stock capital actions"),
    ("j.p. morgan se", "Regulatory capital for subsidiaries"),
    ("j.p. morgan securities plc", "Regulatory capital for subsidiaries"),
    ("jpmorgan chase bank, n.a.", "Regulatory capital for bank subsidiary"),
    ("liquidity risk", "Liquidity risk management"),
    ("liquidity management", "Liquidity risk management"),
    ("contingency funding", "Contingency funding plan"),
    ("long-term funding", "Long-term funding"),
    ("credit risk", "Credit risk management"),
    ("consumer credit", "Consumer credit risk"),
    ("wholesale credit", "Wholesale credit risk"),
    ("allowance for credit losses", "Allowance for credit losses"),
    ("market risk", "Market risk management"),
    ("value-at-risk", "Value-at-risk"),
    ("operational risk", "Operational risk management"),
    ("model risk", "Model risk management"),
    ("reputation risk", "Reputation risk management"),
    ("climate risk", "Climate risk management"),
    ("critical accounting", "Critical accounting estimates"),
)
RISK_TOPICS = (
    ("cyber", "Cybersecurity risk"),
    ("data", "Data and technology risk"),
    ("market", "Market risk"),
    ("credit", "Credit risk"),
    ("liquidity", "Liquidity risk"),
    ("capital", "Capital risk"),
    ("regulat", "Legal and regulatory risk"),
    ("government", "Government policy risk"),
    ("political", "Political and geopolitical risk"),
    ("competition", "Competitive risk"),
    ("employee", "People risk"),
    ("country", "Country risk"),
    ("reputation", "Reputation risk"),
    ("conduct", "Conduct risk"),
    ("strateg", "Strategic risk"),
    ("operational", "Operational risk"),
)
GENERIC_TITLES = {
    "business": "Business overview",
    "risk factors": "Risk factors",
    "management's discussion and analysis": "Management discussion and analysis",
    "item 7 md&a": "Management discussion and analysis",
    "partially offset by": "Financial performance drivers",
    "largely offset by": "Financial performance drivers",
}
LOW_VALUE_TOPICS = ("management discussion and analysis", "financial performance drivers")
LOW_VALUE_STARTS = ("comparisons noted in the sections below", "selected business metrics")
LOW_VALUE_CONTAINS = ("the following is a discussion",)
TITLE_CUT = r",|\breflecting\b|\bdriven by\b|\bincluding\b|\bwas\b|\bare\b"


def semantic_topic(title: Column, section: Column, text: Column) -> Column:
    raw = F.regexp_replace(strip(F.regexp_replace(title, r"^Item\s+\d+[A-Z]?\.\s*", "")), r"[.:]+$", "")

    def titled(raw: Column) -> Column:
        short = F.regexp_replace(F.regexp_replace(F.split(raw, TITLE_CUT, 2)[0], rf"{BLANK}+", " "), r"^[ .:\-]+|[ .:\-]+$", "")
        words = F.array_join(F.slice(F.split(short, " "), 1, 7), " ")
        generic = F.lit(None).cast("string")
        for name, topic in GENERIC_TITLES.items():
            generic = F.when(F.lower(raw) == name, topic).otherwise(generic)
        return F.coalesce(generic, F.nullif(words, F.lit("")), section)

    def ruled(hay: Column, raw: Column) -> Column:
        last = F.when(section == RISK, first_match(hay, RISK_TOPICS, F.lit("Risk factor"))).otherwise(titled(raw))
        rest = first_match(hay, TOPIC_RULES, last)
        return first_match(hay, PRIORITY_TOPICS, F.when((section == MDA) & hay.rlike(r"\bvar\b"), "Value-at-risk").otherwise(rest))

    return let(raw, lambda raw: let(F.lower(F.concat(raw, F.lit(" "), text)), lambda hay: ruled(hay, raw)))


def low_value(topic: Column, text: Column) -> Column:
    low = F.lower(text)
    return F.lower(topic).isin(*LOW_VALUE_TOPICS) | reduce(lambda a, b: a | b, [F.startswith(low, F.lit(s)) for s in LOW_VALUE_STARTS]) | has_any(low, LOW_VALUE_CONTAINS)


# --- Taxonomy (fixed values): secondary topics by the first group of needles that a text holds. ---
REGULATORY = (
    ("capital_regulation", ("capital", "basel", "tlac", "mrel")),
    ("litigation_and_enforcement", ("litigation", "enforcement", "penalt")),
    ("consumer_finance_regulation", ("consumer", "cfpb")),
    ("interchange_fee_regulation", ("interchange",)),
    ("jurisdictional_regulation", ("jurisdiction", "country", "u.k.", "eu")),
    ("legal_risk", ("legal",)),
)
FINANCIAL = (
    ("liquidity_risk", ("liquidity",)),
    ("funding_risk", ("funding", "deposit")),
    ("market_risk", ("market", "var", "value-at-risk")),
    ("lending_commitments", ("commitment",)),
    ("collateral_and_margin", ("collateral", "margin")),
)
OPERATIONAL = (
    ("cyber_risk", ("cyber",)),
    ("technology_risk", ("technology", "data")),
    ("model_governance", ("model governance", "governance")),
    ("model_risk", ("model",)),
)
PERFORMANCE = (
    ("expense_drivers", ("expense", "compensation")),
    ("balance_sheet_trends", ("balance", "cash flow", "assets", "liabilities")),
    ("receivables", ("receivable",)),
    ("segment_performance", ("segment", "consumer banking", "investment banking")),
)
SEGMENT = (
    ("consumer_banking", ("consumer", "ccb")),
    ("investment_banking", ("investment", "cib", "markets")),
    ("asset_wealth_management", ("asset", "wealth", "awm")),
)
STRUCTURE = (
    ("international_structure", ("international", "outside the u.s.", "jpmse")),
    ("bank_subsidiaries", ("bank subsidiary", "national bank")),
)
_SECONDARY = {
    "regulatory": (REGULATORY, "supervision_and_compliance"),
    "financial": (FINANCIAL, "credit_risk"),
    "operational": (OPERATIONAL, "technology_risk"),
    "performance": (PERFORMANCE, "revenue_drivers"),
    "segment": (SEGMENT, "segment_overview"),
    "structure": (STRUCTURE, "major_subsidiaries"),
}
#: For each section: (where to look, needles, primary topic, secondary topic or the table that gives it).
TAXONOMY = {
    BUSINESS: (
        ("topic", ("competitive", "competition"), "competition", "competitive_environment"),
        ("topic", ("business segment",), "business_segment", "segment_overview"),
        ("topic", ("subsidiar", "structure"), "business_structure", "structure"),
        ("all", ("overview", "leading financial services", "operations worldwide"), "company_overview", "company_profile"),
        ("all", ("subsidiar", "operating structure", "bank, n.a.", "jpmse"), "business_structure", "structure"),
        ("all", ("business segment", "consumer & community banking"), "business_segment", "segment_overview"),
        ("all", ("competition", "competitive"), "competition", "competitive_environment"),
        ("all", ("regulation", "supervision", "compliance", "capital requirement"), "regulatory_risk", "regulatory"),
        ("all", ("",), "company_overview", "company_profile"),
    ),
    RISK: (
        ("all", ("cyber", "technology", "data", "operational", "model"), "operational_risk", "operational"),
        ("all", ("credit", "market", "liquidity", "funding", "capital", "collateral", "margin"), "financial_risk", "financial"),
        ("all", ("regulat", "legal", "litigation", "government", "jurisdiction", "compliance"), "regulatory_risk", "regulatory"),
        ("all", ("competition", "strategy", "strategic", "country", "geopolitical", "people", "reputation", "conduct"), "operational_risk", "operational"),
        ("all", ("",), "operational_risk", "operational_risk"),
    ),
    MDA: (
        ("all", ("revenue", "expense", "income", "tax", "balance sheet", "cash flow", "receivable", "segment performance", "markets revenue"), "performance_analysis", "performance"),
        ("all", ("credit", "market", "liquidity", "funding", "var", "collateral", "margin", "allowance"), "financial_risk", "financial"),
        ("all", ("capital", "basel", "tlac", "stress capital", "mrel", "regulatory requirement"), "regulatory_risk", "capital_regulation"),
        ("all", ("cyber", "technology", "operational", "model", "governance", "control"), "operational_risk", "operational"),
        ("all", ("consumer banking", "investment banking", "asset and wealth", "business segment"), "business_segment", "segment"),
        ("all", ("",), "performance_analysis", "segment_performance"),
    ),
}


def secondary_topic(table: str, hay: Column) -> Column:
    groups, otherwise = _SECONDARY[table]
    return first_group(hay, groups, otherwise)


def taxonomy(topic: Column, title: Column, text: Column, section: Column) -> Column:
    """Struct of primary_topic and secondary_topic. Sections other than the first two are taken as the third."""

    def pick(rules: tuple, low: Column, hay: Column) -> Column:
        first, second = F.lit(None).cast("string"), F.lit(None).cast("string")
        for where, needles, primary, secondary in reversed(rules):
            hit = has_any(low if where == "topic" else hay, needles)
            first = F.when(hit, primary).otherwise(first)
            second = F.when(hit, secondary_topic(secondary, hay) if secondary in _SECONDARY else F.lit(secondary)).otherwise(second)
        return F.struct(first.alias("primary_topic"), second.alias("secondary_topic"))

    def choose(both: Column) -> Column:
        low, hay = both["low"], both["hay"]
        return F.when(section == BUSINESS, pick(TAXONOMY[BUSINESS], low, hay)).when(section == RISK, pick(TAXONOMY[RISK], low, hay)).otherwise(pick(TAXONOMY[MDA], low, hay))

    hay = F.lower(F.concat(topic, F.lit(" "), title, F.lit(" "), text))
    return let(F.struct(F.lower(topic).alias("low"), hay.alias("hay")), choose)


def quality_label(kind: Column, text: Column) -> Column:
    n = F.length(text)
    target = n.between(300, 1200)
    return (
        F.when(kind == "table_summary", F.when(target, "high").otherwise("medium"))
        .when(target & (count_words(text) >= 35), "high")
        .when(n.between(150, 1500), "medium")
        .otherwise("low")
    )
