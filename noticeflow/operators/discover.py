"""Discovery over a table of captured pages: what a page is, and a search from seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.functions import text as T
from noticeflow.functions import urls as U
from noticeflow.operators import boards
from noticeflow.sources import pages
from noticeflow.storage import written

def site_root(host: Column) -> Column:
    """The registered domain of a host: three labels below the listed suffixes, else two."""
    parts = F.split(F.lower(host), r"\.")
    n = F.size(parts)
    suffix = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2), ".")
    take = F.when((n >= 3) & suffix.isin(*rules.SECOND_LEVELS), 3).otherwise(2)
    return F.array_join(F.slice(parts, F.greatest(n - take + 1, F.lit(1)), take), ".")


def verdict(url: Column, home: Column, rows: Column, dated: Column) -> Column:
    """What a probed page is, from its address and its dated rows; null rows: not captured."""
    inside = (site_root(T.host(url)) == site_root(home)) | T.host(url).endswith(F.concat(F.lit("."), home))
    return (
        F.when(~inside, "external")
        .when(U.looks_like_home(url), "home")
        .when(U.looks_like_article(url), "article")
        .when(rows.isNull() | (rows < 2), "static")
        .when(dated * 2 < rows, "index")
        .otherwise("list")
    )


def probe(captured: DataFrame) -> DataFrame:
    """(page_id, url, rows, dated, verdict) of captured pages (page_id, url, html, home)."""
    counts = boards.lists(captured).select("page_id", F.size("posts").alias("rows"), F.size(F.filter("posts", lambda p: p["published"].isNotNull())).alias("dated")).where("rows > 0")
    rows = captured.select("page_id", "url", "home").join(counts, "page_id", "left")
    return rows.select("page_id", "url", "rows", "dated", verdict(F.col("url"), F.col("home"), F.col("rows"), F.coalesce("dated", F.lit(0))).alias("verdict"))


def search(corpus: DataFrame, seeds: DataFrame, budget: int = 40, rounds: int = 6) -> DataFrame:
    """(home, url, round, place) of the pages a search from each seed (home, url) opens.

    Each round opens the captured pages of its frontier; the links to the same site that
    were not seen yet, best board score first, are the next, within a budget for each home.
    """
    opened = written(seeds.select("home", "url", F.lit(0).alias("round"), F.lit(1).alias("place")).distinct(), "search")
    frontier = opened
    for n in range(1, rounds + 1):
        found = frontier.select("home", "url").join(corpus.select("url", "html"), "url")
        keyed = found.select(F.struct("home", "url").alias("_k"), "url", "html").withColumn("page_id", F.xxhash64("_k.home", "url"))
        links = pages.anchors(keyed.select("page_id", "url", "html")).withColumnRenamed("url", "link")
        same = links.join(keyed.select("page_id", "_k.home").distinct(), "page_id").where(site_root(T.host(F.col("link"))) == site_root(T.host(F.col("home"))))
        fresh = same.groupBy("home", F.col("link").alias("url")).agg(F.max("text").alias("text")).join(opened.select("home", "url"), ["home", "url"], "left_anti")
        used = opened.groupBy("home").agg(F.count(F.lit(1)).alias("_used"))
        order = Window.partitionBy("home").orderBy(F.desc(T.board_score(F.col("url"), F.col("text"))), "url")
        ranked = fresh.join(used, "home").withColumn("place", F.row_number().over(order)).where(F.col("place") + F.col("_used") <= budget)
        frontier = written(ranked.select("home", "url", F.lit(n).alias("round"), "place"), "search")
        if frontier.isEmpty():
            break
        opened = written(opened.unionByName(frontier), "search")
    return opened
