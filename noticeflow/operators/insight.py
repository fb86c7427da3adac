"""Clusters as issues, timelines and briefs; reports as groups of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.operators import relevance

#: A cluster is known by the source and item of its leader.
LEADER = ("leader_src", "leader_item")


def issues(clusters: DataFrame, k: int = 5) -> DataFrame:
    """(pos, title, n, agencies) of clusters of two or more: largest, newest leader, title."""
    is_lead = (F.col("src_idx") == F.col("leader_src")) & (F.col("item_idx") == F.col("leader_item"))
    lead = lambda c: F.max(F.when(is_lead, F.col(c)))
    groups = clusters.groupBy(*LEADER).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("agency").alias("agencies"), lead("title").alias("title"), lead("published").alias("published"))
    order = [F.desc("n"), F.desc_nulls_last("published"), F.col("title"), *map(F.col, LEADER)]
    top = groups.where("n >= 2").orderBy(*order).limit(k)
    # At most k rows by now, so one task may number them.
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def timeline(clusters: DataFrame, k: int = 6) -> DataFrame:
    """(pos, day, title, agency) of the first issue: oldest first, undated last."""
    first = issues(clusters, 1).select(*LEADER)
    order = [F.asc_nulls_last("published"), F.col("title"), F.col("src_idx"), F.col("item_idx")]
    top = clusters.join(F.broadcast(first), list(LEADER)).orderBy(*order).limit(k)
    day = F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("미상"))
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), day.alias("day"), "title", "agency")


def brief(matches: DataFrame, theme: relevance.Theme) -> DataFrame:
    """(section_ord, pos, section, title, score, n) of a brief: sections in the theme's order.

    ``matches`` are clustered within their sections.  A section without matches is not there.
    """
    names = [n for n, _ in theme.sections] + [rules.OTHER]
    place = F.array_position(F.array(*map(F.lit, names)), F.col("section"))
    size = matches.groupBy("section", *LEADER).agg(F.count(F.lit(1)).alias("n"))
    lead = relevance.leads(matches.withColumn("_g", F.concat_ws("/", "section", *LEADER)), "_g").drop("_g")
    order = Window.partitionBy("section").orderBy(F.desc("score"), F.desc("n"), F.desc_nulls_last("published"), "title", "src_idx", "item_idx")
    rows = lead.join(size, ["section", *LEADER]).withColumn("pos", F.row_number().over(order))
    return rows.select(place.cast("int").alias("section_ord"), "pos", "section", "title", "score", "n")


def brief_totals(matches: DataFrame, considered: DataFrame) -> DataFrame:
    """One row: notices looked at, matches, issues, agencies and new ones."""
    issue = F.concat_ws("/", "section", *LEADER)
    own = matches.agg(F.count(F.lit(1)).alias("matches"), F.count_distinct(issue).alias("issues"), F.count_distinct("agency").alias("agencies"), F.count_if("is_new").alias("new"))
    return considered.agg(F.count(F.lit(1)).alias("considered")).join(F.broadcast(own))


def report_totals(notices: DataFrame) -> DataFrame:
    """(agency, n, new) of a report, by name."""
    return notices.groupBy("agency").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("new"))


def agency_rows(notices: DataFrame) -> DataFrame:
    """(agency, pos, ...) of a report's rows by agency: newest first, then source order.

    The rows of one agency are sorted by one task, which may spill; none gathers them.
    """
    order = Window.partitionBy("agency").orderBy(F.desc_nulls_last("published"), "src_idx", "item_idx")
    return notices.withColumn("pos", F.row_number().over(order))


def verify_groups(notices: DataFrame) -> DataFrame:
    """(org, count, groups): rows of each organisation, and of each category as text."""
    from noticeflow.operators import digest

    counts = notices.groupBy("org", digest.category_name().alias("group")).agg(F.count(F.lit(1)).alias("n"))
    # One entry for each category there can be.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "n"))), lambda x: F.concat_ws("=", x["group"], x["n"].cast("string"))), ",")
    return counts.groupBy("org").agg(F.sum("n").alias("count"), text.alias("groups"))


def verify_lines(results: DataFrame) -> DataFrame:
    """(id, line): id, name, count, mode, seconds and the first reason, tabs between."""
    cut = F.substring(F.coalesce("reason", F.lit("")), 1, 160)
    parts = ["id", "name", F.coalesce(F.col("count"), F.lit(0)).cast("string"), F.coalesce("mode", F.lit("-")), F.coalesce(F.col("elapsed").cast("string"), F.lit("-")), cut]
    return results.select("id", F.concat_ws("\t", *parts).alias("line"))
