"""Scalar rules as Catalyst expressions; no Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.functions.korean import aliases


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column) -> Column:
    """White space, of any script, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column, longest: int = 280) -> Column:
    """Tags to spaces, five entities undone, white space squeezed; cut with an ellipsis."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    plain = squeeze(plain)
    cut = F.concat(F.rtrim(F.substring(plain, 1, longest - 1)), F.lit("…"))
    return F.when(F.length(plain) > longest, cut).otherwise(plain)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({rules.TOKEN})"), F.lit(1))


def strip_suffix(c: Column) -> Column:
    """One longest closed suffix off, when two characters stay: the stem is matched lazily."""
    return F.regexp_replace(c, f"^(.{{2,}}?)(?:{'|'.join(rules.SUFFIXES)})$", "$1")


def is_topical(word: Column) -> Column:
    return (F.length(word) >= 2) & ~word.rlike("^[0-9]+$") & ~casefold(word).isin(*rules.STOPWORDS) & ~word.rlike(rules.ORDINAL)


def title_tokens(c: Column) -> Column:
    """Distinct topical words of a title, without closed suffixes, case folded."""
    return F.array_distinct(F.transform(F.filter(F.transform(words(c), strip_suffix), is_topical), casefold))


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    """One expression for all parts, so that a long list does not outgrow compiled code."""
    words = [re.escape(p) for p in parts]
    return text.rlike("|".join(words)) if words else F.lit(False)


def _first(text: Column, table) -> Column:
    low = F.lower(squeeze(F.coalesce(text, F.lit(""))))
    out = F.lit("")
    for name, hints in reversed(table):
        out = F.when(contains_any(low, hints), name).otherwise(out)
    return out


def classify(text: Column) -> Column:
    """The first category one of whose words is in the text; else empty."""
    return _first(text, rules.CATEGORY_HINTS)


def canonical(text: Column) -> Column:
    found = classify(text)
    return F.when(found == "", rules.OTHER).otherwise(found)


def for_title(title: Column) -> Column:
    return _first(title, rules.TITLE_HINTS)


def notice_category(label: Column, title: Column) -> Column:
    """The board's label if it names the category, else the title's, else the label."""
    by_title = for_title(title)
    return F.when(canonical(label).isin(*rules.SPECIFIC), label).when(by_title != "", by_title).otherwise(label)


def tier(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(t.isin(*rules.TIERS), t).otherwise("unknown")


def badge(c: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in rules.TIER_BADGES.items() for x in kv)), tier(c))


def allows_derivative(c: Column) -> Column:
    return ~tier(c).isin(*rules.NO_DERIVATIVES)


def dedup_key(url: Column, agency: Column, title: Column) -> Column:
    """The link, case folded; without one, agency and title."""
    link = F.trim(F.coalesce(url, F.lit("")))
    return casefold(F.when(link != "", link).otherwise(F.concat(agency, F.lit("\x1f"), squeeze(title))))


def _day(c: Column, pattern: str, century: str = "", parts=(1, 2, 3)) -> tuple[Column, Column]:
    """(whether the pattern is there, the date of its first match; null if there is no such day)."""
    y, m, d = (F.regexp_extract(c, pattern, i) for i in parts)
    return y != "", F.try_to_date(F.concat(F.lit(century), y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _first_of(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for found, value in reversed(cases):
        out = F.when(found, value).otherwise(out)
    return out


def coerce_date(c: Column) -> Column:
    """A date anywhere in a text.  The first form that is there decides, not the leftmost
    date: full year, Korean, eight digits, two-digit year."""
    edge, after = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    short = r"(?<![\d.])(\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})(?![\d.])"
    cases = [
        _day(c, rf"{edge}(20\d{{2}})[.\-/](\d{{1,2}})[.\-/](\d{{1,2}}){after}"),
        _day(c, r"(20\d{2})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"),
        _day(c, r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)"),
        _day(c, short, "20"),
    ]
    return _first_of(cases, F.lit(None).cast("date"))


_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def parse_date(c: Column) -> Column:
    """A date at the start or eight digits alone (never any later form, if there is no such
    day), the date of a mail header, or any form of ``coerce_date``."""
    s = F.trim(c)
    mail = r"(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})"
    month = F.regexp_extract(s, mail, 2)
    day = F.try_to_date(F.concat_ws(" ", F.lpad(F.regexp_extract(s, mail, 1), 2, "0"), month, F.regexp_extract(s, mail, 3)), "dd MMM yyyy")
    cases = [_day(s, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"), _day(s, r"^(\d{4})(\d{2})(\d{2})$"), (month.rlike(f"^(?:{_MONTHS})$"), day)]
    return _first_of(cases, coerce_date(s))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def bare_host(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def is_external(url: Column, home: str) -> Column:
    """A known system elsewhere, or neither the home host nor below it."""
    own, h = home.removeprefix("www."), bare_host(host(url))
    known = F.lit(False)
    for x in rules.EXTERNAL_HOSTS:
        known = known | (h == x) | h.endswith("." + x)
    return known | ~((h == own) | h.endswith("." + own))


@lru_cache(maxsize=1)
def _romanised() -> str:
    """An expression for any category word as it is spelt in addresses."""
    return "|".join(sorted({a for _, words in rules.CATEGORY_HINTS for w in words for a in aliases(w)}))


def board_score(url: Column, label: Column) -> Column:
    """How likely a link is a board list: words of the address, label, and depth."""
    low = F.lower(F.coalesce(url, F.lit("")))
    hits = sum((low.contains(x).cast("int") for x in rules.BOARD_HINTS[1:]), low.contains(rules.BOARD_HINTS[0]).cast("int"))
    head = F.rtrim(F.element_at(F.split(low, r"\?", 2), 1), F.lit("/"))
    depth = F.length(head) - F.length(F.replace(head, F.lit("/"), F.lit(""))) - 2
    return (
        F.least(hits, F.lit(3)) * 2
        + F.when(contains_any(low, rules.QUERY_HINTS), 2).otherwise(0)
        + F.when(low.rlike(_romanised()), 3).otherwise(0)
        - F.when(contains_any(low, rules.INTRO_HINTS), 3).otherwise(0)
        + F.when(classify(label) != "", 3).otherwise(0)
        - F.least(F.abs(depth - 3), F.lit(3))
    )


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, both / (F.size(a) + F.size(b) - both)).otherwise(0.0)
