"""Counts by agency, category and keyword; groupings; weekly activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.functions import text as T


def top(counts: DataFrame, name: str, k: int) -> DataFrame:
    """The k largest counts, ties by name."""
    return counts.orderBy(F.desc("n"), name).limit(k)


def count_by(notices: DataFrame, key: Column, name: str) -> DataFrame:
    return notices.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def category_name() -> Column:
    return F.when(F.trim(F.coalesce("category", F.lit(""))) == "", rules.UNSORTED).otherwise(T.canonical(F.col("category")))


def agencies(notices: DataFrame, k: int = 12) -> DataFrame:
    return top(count_by(notices, F.col("agency"), "agency"), "agency", k)


def categories(notices: DataFrame, k: int = 10) -> DataFrame:
    return top(count_by(notices, category_name(), "category"), "category", k)


def other_labels(notices: DataFrame, k: int = 10) -> DataFrame:
    """The raw labels that no category takes."""
    return top(count_by(notices.where(category_name() == rules.OTHER), F.col("category"), "label"), "label", k)


def totals(notices: DataFrame, k_agencies: int = 12, k_categories: int = 10) -> DataFrame:
    """One row: rows, distinct agencies and categories, and what the two tops leave out."""
    a, c = count_by(notices, F.col("agency"), "name"), count_by(notices, category_name(), "name")

    def part(counts: DataFrame, k: int, label: str) -> DataFrame:
        whole = counts.agg(F.count(F.lit(1)).alias(f"distinct_{label}"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        shown = top(counts, "name", k).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("shown"), F.count(F.lit(1)).alias("listed"))
        both = whole.withColumn("_", F.lit(1)).join(shown.withColumn("_", F.lit(1)), "_").drop("_")
        return both.select(
            F.col("total"),
            f"distinct_{label}",
            F.greatest(F.lit(0), F.col(f"distinct_{label}") - F.col("listed")).alias(f"{label}_more"),
            (F.col("total") - F.col("shown")).alias(f"{label}_rest"),
        )

    return part(a, k_agencies, "agency").join(part(c, k_categories, "category"), "total")


def keywords(notices: DataFrame, k: int = 8) -> DataFrame:
    """Words of titles, once a title, case kept; names of agencies and form words left out.

    Agency names are aggregated before they meet the words, by an anti join.
    """
    names = notices.select("agency").distinct()
    skip = names.select(F.explode(F.concat(F.array(T.casefold(F.col("agency"))), F.transform(T.words(F.col("agency")), T.casefold))).alias("word")).distinct()
    tokens = notices.select(F.explode(F.array_distinct(T.words(F.col("title")))).alias("word")).where(T.is_topical(F.col("word")))
    counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.withColumn("_low", T.casefold(F.col("word"))).join(skip.withColumnRenamed("word", "_low"), "_low", "left_anti").select("word", "n")
    size = notices.limit(2).count()
    return top(kept, "word", k).where(F.col("n") >= (1 if size == 1 else 2))


def new_keywords(notices: DataFrame, k: int = 6) -> DataFrame:
    """Title tokens of new rows that no other row has, by count; none without both kinds."""
    tokens = notices.select("is_new", F.explode(T.title_tokens(F.col("title"))).alias("word"))
    counts = tokens.groupBy("word").agg(F.count_if("is_new").alias("n"), F.count_if(~F.col("is_new")).alias("old"))
    kinds = notices.agg(F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("rest")).head()
    if not kinds["new"] or not kinds["rest"]:
        counts = counts.limit(0)
    return top(counts.where("old = 0").select("word", "n"), "word", k)


def topics(notices: DataFrame) -> DataFrame:
    """Rows per topic, a notice under each of its topics; the rest under one name, last."""
    names = F.when(F.size("topics") == 0, F.array(F.lit(rules.OTHER))).otherwise(F.col("topics"))
    counts = notices.select(F.explode(names).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy((F.col("topic") == rules.OTHER).cast("int"), F.desc("n"), "topic")
    return counts.withColumn("pos", F.row_number().over(order))


def organisations(notices: DataFrame) -> DataFrame:
    """Rows per organisation and site, both largest first."""
    named = lambda c: F.coalesce(F.nullif(c, F.lit("")), "agency")
    counts = notices.groupBy(named("org").alias("org"), named("site").alias("site")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("org"))
    ranked = counts.withColumn("org_n", total)
    return ranked.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("org_n"), "org", F.desc("n"), "site")))


def activity(notices: DataFrame, k: int = 6) -> DataFrame:
    """Rows and last date per agency."""
    counts = notices.groupBy("agency").agg(F.count(F.lit(1)).alias("n"), F.max("published").alias("latest"))
    return top(counts, "agency", k)


def weekly(notices: DataFrame, weeks: int = 8) -> DataFrame:
    """Rows per Monday week, zeros included, for the weeks up to the last one with a row."""
    counts = notices.where("published is not null").groupBy(F.date_trunc("week", "published").cast("date").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    last = counts.agg(F.max("week").alias("last")).where("last is not null")
    spine = last.select(F.explode(F.sequence(F.date_sub("last", 7 * (weeks - 1)), F.col("last"), F.expr("interval 7 days"))).alias("week"))
    return spine.join(counts, "week", "left").select("week", F.date_format("week", "MM/dd").alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


def trend(weeks: DataFrame) -> DataFrame:
    """One row: the two halves, the change in whole percent (half to even), and its kind."""
    rows = weeks.withColumn("rank", F.row_number().over(Window.orderBy("week"))).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy()))
    half = F.expr("size div 2")
    sums = rows.agg(
        F.coalesce(F.sum(F.when(F.col("rank") <= half, F.col("n"))), F.lit(0)).alias("previous"),
        F.coalesce(F.sum(F.when(F.col("rank") > half, F.col("n"))), F.lit(0)).alias("recent"),
        F.count(F.lit(1)).alias("weeks"),
    )
    change = (F.col("recent") - F.col("previous")) / F.nullif("previous", F.lit(0)) * 100
    kind = (
        F.when((F.col("weeks") < 4) | ((F.col("previous") == 0) & (F.col("recent") == 0)), "")
        .when(F.col("previous") == 0, "started")
        .when(change >= 15, "up")
        .when(change <= -15, "down")
        .otherwise("steady")
    )
    return sums.select("previous", "recent", F.bround(change, 0).cast("long").alias("percent"), kind.alias("kind"))
