"""Names of boards and titles of posts as Catalyst expressions.

Texts are read with their white space squeezed.  Nulls are empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.functions import text as T

#: One operating word without spaces, and any run of operating words without spaces.
_WORD = "(?:" + "|".join(re.escape(w) for w in rules.MEANINGLESS if " " not in w) + ")"
_GLUED = "^(?:" + "|".join(sorted({re.escape(w.replace(" ", "")) for w in rules.MEANINGLESS}, key=len, reverse=True)) + ")+$"


def _flat(c: Column) -> Column:
    return T.squeeze(F.coalesce(c, F.lit("")))


def is_meaningless(c: Column) -> Column:
    """An operating word, and no name."""
    return F.lower(_flat(c)).isin(*rules.MEANINGLESS)


def strip_meaningless(c: Column) -> Column:
    """Operating words off both ends."""
    tail = F.regexp_replace(_flat(c), f"(?i)(?:(?:^| ){_WORD})+$", "")
    return F.trim(F.regexp_replace(tail, f"(?i)^(?:{_WORD}(?: |$))+", ""))


def glued(c: Column) -> Column:
    """Operating words and nothing else, written together or not."""
    return F.lower(F.replace(c, F.lit(" "), F.lit(""))).rlike(_GLUED)


def tidy_label(c: Column) -> Column:
    """A board's name fit to be shown; empty if it is none."""
    flat = F.regexp_replace(F.regexp_replace(_flat(c), rules.PLUS_SPACE, " "), rules.LEAD_BULLET, "")
    bare = strip_meaningless(flat)
    cut = F.trim(F.regexp_replace(bare, rules.TRAIL_BUTTON, ""))
    name = F.trim(F.regexp_replace(F.when(F.length(cut) >= 2, cut).otherwise(bare), rules.LIST_TAIL, ""))
    return F.when(glued(flat) | (bare == "") | glued(bare), "").otherwise(name)


def is_named(c: Column) -> Column:
    return tidy_label(c) != ""


def is_date_only(c: Column) -> Column:
    """A date and nothing else but its label and marks."""
    rest = F.regexp_replace(F.regexp_replace(c, rules.DATE_LABEL, ""), rules.DATE_NOISE, "")
    return T.coerce_date(c).isNotNull() & (F.length(rest) <= 4)


def only_buttons(c: Column) -> Column:
    return T.squeeze(F.regexp_replace(c, rules.BRACKETS, " ")).rlike(rules.BUTTON_WORDS)


def is_button(c: Column) -> Column:
    """Text of a button that opens or fetches something."""
    t = _flat(c)
    return t.rlike(rules.BUTTON_TITLE) | t.rlike(rules.ATTACH_CELL) | only_buttons(t) | is_meaningless(t)


def is_junk_title(c: Column) -> Column:
    """Text that is no title: files, addresses, locked posts, spam, buttons, pages, menus."""
    t = _flat(c)
    addresses = F.aggregate(F.regexp_extract_all(t, F.lit(rules.URL_IN_TITLE), F.lit(0)), F.lit(0), lambda n, m: n + F.length(m))
    out = (t == "") | (F.length(t) > rules.LONGEST_TITLE) | only_buttons(t) | is_meaningless(t) | ((addresses > 0) & (addresses * 2 >= F.length(t)))
    for pattern in (rules.ATTACH_CELL, rules.URL_TITLE, rules.SECRET, rules.SPAM, rules.USER_ID, rules.BUTTON_TITLE, rules.PAGING):
        out = out | t.rlike(pattern)
    return out


def clean_title(c: Column) -> Column:
    """Struct (title, unit): badges, marks of files and a row's other facts off; ``[unit]`` out."""
    t = F.regexp_replace(_flat(F.regexp_replace(c, rules.INVISIBLE, "")), rules.ATTACH_HEAD, "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, rules.ICON_ATTACH, "$1"), rules.ICON_NEW, " "))
    t = F.regexp_replace(t, rules.BADGE, "")
    unit = F.substring(F.trim(F.regexp_extract(t, rules.ORG_PREFIX, 1)), 1, rules.LONGEST_UNIT)
    t = F.regexp_replace(F.trim(F.regexp_replace(t, rules.ORG_PREFIX, "")), rules.BADGE, "")
    # The first place where other facts begin, and what begins there.
    fact = F.regexp_extract(t, rules.META_CUT, 0)
    at = F.when(fact != "", F.length(F.regexp_extract(t, f"^(.*?)(?:{rules.META_CUT})", 1))).otherwise(-1)
    head = F.substring(t, F.lit(1), at)
    head = F.when(F.trim(fact).startswith("조회"), F.regexp_replace(head, rules.DEPT_TAIL, "")).otherwise(head)
    t = F.when(at >= rules.LEAST_TITLE, head).otherwise(t)
    for _ in range(2):
        t = F.trim(F.regexp_replace(F.regexp_replace(t, rules.ATTACH_TAIL, ""), rules.BADGE_TAIL, ""))
    return F.struct(t.alias("title"), unit.alias("unit"))


def title_key(title: Column, published: Column) -> Column:
    """Title without tags at its ends, case folded, with its date; null without either."""
    bare = T.casefold(F.regexp_replace(F.regexp_replace(_flat(title), rules.TITLE_TAG_HEAD, ""), rules.TITLE_TAG_TAIL, ""))
    return F.when((bare != "") & published.isNotNull(), F.concat(F.lit("t\x1f"), bare, F.lit("\x1f"), published.cast("string")))


def page_label(parts: Column) -> Column:
    """The first fragment of a page's titles that names a board; empty if none does.

    ``parts`` is an array of texts: the title, then the headings, in order.
    """
    each = F.flatten(F.transform(parts, lambda p: F.split(F.coalesce(p, F.lit("")), rules.NAME_SEPARATOR)))
    tidy = F.transform(each, tidy_label)
    named = F.filter(tidy, lambda x: F.length(x).between(2, rules.LONGEST_NAME) & (T.classify(x) != ""))
    return F.coalesce(F.get(named, F.lit(0)), F.lit(""))


def not_notice(label: Column) -> Column:
    return label.rlike(rules.NOT_NOTICE)


def slot_of(c: Column) -> Column:
    """The slot of a school that a menu's name fills; empty if none."""
    label = tidy_label(c)
    group = T.classify(label)
    fits = (label != "") & (F.length(label) <= rules.LONGEST_LABEL) & ~not_notice(label) & ~label.rlike(rules.YEAR_IN_LABEL) & group.isin(*rules.TARGETS)
    return F.when(fits, group).otherwise("")


def slot_score(slot: Column, label: Column, url: Column) -> Column:
    """How likely a candidate is the board of its slot."""
    department = label.rlike(rules.DEPARTMENT)
    main = F.when(F.lower(label).isin(*rules.MAIN_NOTICE), 4).otherwise(0) - F.when(label.rlike(rules.DEPARTMENT_HINT), 6).otherwise(0)
    return (
        T.board_score(url, label)
        + F.when(label.rlike(rules.BOARDISH), 6).otherwise(0)
        - F.when(label.rlike(rules.LOW_VALUE), 3).otherwise(0)
        - F.when(department, 6).when(label.contains("대학원"), 3).otherwise(0)
        + F.when(slot == "공지", main).otherwise(0)
    )
