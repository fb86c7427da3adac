"""Collecting notices: period and agency filters, stable deduplication, quotation, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions import text as T

SEQUENCE = ("src_idx", "item_idx")


def since(notices: DataFrame, now: str, days: int | None) -> DataFrame:
    """Keeps dates in the period, and notices without a date; 0 or None keeps all."""
    if not days:
        return notices
    return notices.where(F.col("published").isNull() | (F.col("published") >= F.date_sub(F.lit(now).cast("date"), days)))


def by_agency(notices: DataFrame, part: str | None) -> DataFrame:
    return notices.where(F.col("agency").contains(part)) if part else notices


def first_wins(notices: DataFrame, key: Column | None = None, order=SEQUENCE, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Of rows with one key the first in source order, found by a partial aggregate.

    Groups of equal keys are never sorted or gathered: each task sends its first row.  The
    aggregate carries all columns, or ``columns`` besides those of the order; name those
    that are needed, as a scan cannot be pruned through it.
    """
    key = T.dedup_key(F.col("url"), F.col("agency"), F.col("title")) if key is None else key
    rows = notices.withColumn("_key", key)
    notices = notices if columns is None else notices.select(*order, *columns)
    names = [c for c in notices.columns if c not in order]
    least = F.min_by(F.struct(*names), F.struct(*order)) if names else F.lit(None)
    got = rows.groupBy("_key").agg(F.min(F.struct(*order)).alias("_o"), least.alias("_r"))
    return got.select(*(F.col(f"_o.{c}" if c in order else f"_r.{c}").alias(c) for c in notices.columns))


def quote(notices: DataFrame, mode: str = "conservative") -> DataFrame:
    """Blanks summaries whose licence allows no derivative, unless ``mode`` is full."""
    if mode == "full":
        return notices
    return notices.withColumn("summary", F.when(T.allows_derivative(F.col("rights")), F.col("summary")).otherwise(""))


def inherit(notices: DataFrame, sources: DataFrame) -> DataFrame:
    """Organisation, site, unit and topics of each notice's source, where it has none."""
    s = sources.select("src_idx", *(F.col(c).alias(f"_{c}") for c in ("name", "org", "site", "topics")))
    own = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.nullif(f"_{c}", F.lit("")), F.lit(""))
    return (
        notices.join(s, "src_idx", "left")
        .withColumn("unit", F.coalesce(F.nullif("unit", F.lit("")), F.nullif("_site", F.lit("")), "_name"))
        .withColumn("org", own("org"))
        .withColumn("site", own("site"))
        .withColumn("topics", F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.coalesce("_topics", F.array().cast("array<string>"))))
        .drop("_name", "_org", "_site", "_topics")
    )


def collected(notices: DataFrame, *, now: str, days: int | None = 730, agency: str | None = None, mode: str = "conservative") -> DataFrame:
    """Filters come before deduplication, so a copy that is filtered out hides no other."""
    return quote(first_wins(by_agency(since(notices, now, days), agency)), mode)


def report_order() -> list[Column]:
    """Newest first, then agency descending, then source order; no date counts as oldest."""
    return [F.desc_nulls_last("published"), F.desc("agency"), *SEQUENCE]


def ranked(notices: DataFrame, k: int) -> DataFrame:
    """The first k notices of the report order, with their rank."""
    top = notices.orderBy(*report_order()).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*report_order())))


def mark_new(notices: DataFrame, seen: DataFrame | None) -> DataFrame:
    """``is_new``: the key is not among those seen; without a state nothing is new."""
    if seen is None:
        return notices.withColumn("is_new", F.lit(False))
    key = T.dedup_key(F.col("url"), F.col("agency"), F.col("title"))
    keys = seen.select(F.col("key").alias("_seen")).distinct()
    return notices.withColumn("_key", key).join(keys, F.col("_key") == F.col("_seen"), "left").withColumn("is_new", F.col("_seen").isNull()).drop("_key", "_seen")


def merge_state(current: DataFrame, previous: DataFrame | None, cap: int = 20_000) -> DataFrame:
    """(pos, key): current keys in order, then previous ones not among them, cut at ``cap``."""
    now = current.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), "key").distinct()
    rows = now
    if previous is not None:
        rest = previous.join(now.select("key"), "key", "left_anti").select(F.lit(1).alias("part"), F.col("pos").cast("long").alias("at"), "key")
        rows = now.unionByName(rest)
    top = rows.orderBy("part", "at", "key").limit(cap)
    return top.select((F.row_number().over(Window.orderBy("part", "at", "key")) - 1).alias("pos"), "key")


def within_days(notices: DataFrame, now: str, days: int) -> DataFrame:
    """Notices of the last days, one to ninety of them, and those without a date."""
    return since(notices, now, min(max(days, 1), 90))


def filtered(notices: DataFrame, group: str = "", org: str = "", word: str = "") -> DataFrame:
    """Rows that fit all that is asked; words are found whatever their case."""
    out = notices
    if group:
        out = out.where(T.canonical(F.col("category")) == group)
    if org:
        out = out.where(F.col("org") == org)
    return out.where(F.lower("title").contains(word.lower())) if word else out


def fresh(notices: DataFrame, seen: DataFrame) -> DataFrame:
    """``is_fresh``: the organisation was seen before, and this address was not."""
    orgs = seen.select("org", F.lit(True).alias("_org")).distinct()
    urls = seen.select("url", F.lit(True).alias("_url")).distinct()
    rows = notices.join(orgs, "org", "left").join(urls, "url", "left")
    return rows.withColumn("is_fresh", F.col("_org").isNotNull() & F.col("_url").isNull()).drop("_org", "_url")


def enriched(notices: DataFrame, links: DataFrame, most: int = 20, mode: str = "conservative") -> DataFrame:
    """``notices`` with ``links``: those of the pages of the first rows whose licence allows it.

    ``links`` has url and an array ``links``.  Rows beyond the budget pass unchanged; the
    rows within it are few by that budget, so they may be broadcast.
    """
    may = F.lit(True) if mode == "full" else T.allows_derivative(F.col("rights"))
    first = notices.where(may & (F.col("url") != "")).orderBy(*report_order()).limit(most).select(*SEQUENCE, "url")
    found = links.join(F.broadcast(first), "url").select(*SEQUENCE, F.col("links").alias("_links"))
    kind = "array<struct<label:string,url:string,kind:string>>"
    return notices.join(F.broadcast(found), list(SEQUENCE), "left").withColumn("links", F.coalesce("_links", F.array().cast(kind))).drop("_links")
