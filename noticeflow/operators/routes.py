"""Routes to boards: first success, trails, plans, fair order, dominant category, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.functions import text as T
from noticeflow.functions import urls as U

#: Of each source and category: stage_ord, stage, robots_ok, fetched, n_rows.
ATTEMPT_KEYS = ("src_idx", "category")


def reason() -> F.Column:
    return (
        F.when(~F.col("robots_ok"), "robots")
        .when(~F.col("fetched"), "fetch failed")
        .when(F.col("n_rows") == 0, "no rows")
        .otherwise("")
    )


def tried(attempts: DataFrame) -> DataFrame:
    """Attempts up to and with the first that gave rows; later ones were never made."""
    w = Window.partitionBy(*ATTEMPT_KEYS)
    ok = F.col("robots_ok") & F.col("fetched") & (F.col("n_rows") > 0)
    first = F.min(F.when(ok, F.col("stage_ord"))).over(w)
    return attempts.withColumn("ok", ok).withColumn("winner", first).where("winner is null or stage_ord <= winner")


def first_success(attempts: DataFrame) -> DataFrame:
    return tried(attempts).where("stage_ord = winner").select(*ATTEMPT_KEYS, "stage", "n_rows")


def trails(attempts: DataFrame) -> DataFrame:
    """The attempts of each source and category as text, in order."""
    text = F.when(F.col("ok"), F.concat("stage", F.lit(": "), F.col("n_rows").cast("string"), F.lit("건"))).otherwise(F.concat("stage", F.lit(": "), reason()))
    rows = tried(attempts).withColumn("text", text)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("stage_ord", "text"))), lambda x: x["text"])
    return rows.groupBy(*ATTEMPT_KEYS).agg(F.array_join(ordered, " → ").alias("trail"), F.max(F.col("ok").cast("int")).alias("succeeded"))


def plan(routes: DataFrame, most: int = 15) -> DataFrame:
    """Of each organisation's routes (group_ord, pos, category, url) the ones to take.

    The first of each address stays; then a route's level is its place within its category,
    and the least levels win, specific categories first.
    """
    key = U.board_key(F.col("url"))
    first = Window.partitionBy("org_id", "_key").orderBy("group_ord", "pos")
    rows = routes.withColumn("_key", key).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    name = T.canonical(F.col("category"))
    rows = rows.withColumn("_name", name).withColumn("_level", F.row_number().over(Window.partitionBy("org_id", "_name").orderBy("group_ord", "pos")))
    rank = F.lit(100 + len(rules.CATEGORY_HINTS))
    for i, (own, _) in enumerate(rules.CATEGORY_HINTS):
        rank = F.when(F.col("_name") == own, i if own in rules.SPECIFIC else 100 + i).otherwise(rank)
    chosen = rows.withColumn("_pick", F.row_number().over(Window.partitionBy("org_id").orderBy("_level", rank, "group_ord", "pos"))).where(F.col("_pick") <= most)
    order = Window.partitionBy("org_id").orderBy("group_ord", "pos")
    return chosen.select("org_id", F.row_number().over(order).alias("place"), "category", "url")


def fair_order(candidates: DataFrame) -> DataFrame:
    """Candidates (home, category, url, label) dealt in turn from their categories."""
    rows = candidates.withColumn("score", T.board_score(F.col("url"), F.col("label")))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("home", "category").orderBy(F.desc("score"), "url")))
    rows = rows.withColumn("_best", F.max("score").over(Window.partitionBy("home", "category")))
    order = Window.partitionBy("home").orderBy("turn", F.desc("_best"), "category")
    return rows.withColumn("place", F.row_number().over(order)).drop("_best")


def dominant(titles: DataFrame, key: str, share: float = 0.6, least: int = 2) -> DataFrame:
    """The category that most titles of a board name, if enough of all its titles do."""
    rank = F.lit(len(rules.TITLE_HINTS))
    for i, (name, _) in enumerate(rules.TITLE_HINTS):
        rank = F.when(F.col("_c") == name, i).otherwise(rank)
    counts = titles.withColumn("_c", T.for_title(F.col("title"))).groupBy(key, "_c").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy(key).agg(
        F.sum("n").alias("total"),
        F.max_by(F.struct("_c", "n"), F.when(F.col("_c") != "", F.struct(F.col("n"), -rank))).alias("best"),
    )
    enough = (F.col("best.n") >= least) & (F.col("best.n") * 100 >= F.lit(round(share * 100)) * F.col("total"))
    return per.select(key, F.when(enough, F.col("best._c")).otherwise("").alias("category"), "total")


def merge_cache(cache: DataFrame, found: DataFrame) -> DataFrame:
    """Upsert and delete: (id, count, checked) of cached and newly checked organisations.

    ``found`` has id, count, checked and status: ok replaces, timeout keeps the old row,
    none deletes it when the organisation could be reached.
    """
    old = cache.select("id", F.col("count").alias("_count"), F.col("checked").alias("_checked"))
    rows = old.join(found, "id", "full")
    keep = F.col("status").isNull() | (F.col("status") == "timeout")
    return (
        rows.where(F.coalesce(F.col("status"), F.lit("")) != "none")
        .select("id", F.when(keep, F.col("_count")).otherwise(F.col("count")).alias("count"), F.when(keep, F.col("_checked")).otherwise(F.col("checked")).alias("checked"))
        .where("count is not null")
    )


#: Stages that ask an organisation's own site.
OWN_STAGES = ("rss", "board", "alt", "list", "page", "api")


def access(checks: DataFrame, roots: DataFrame) -> DataFrame:
    """Verdict per organisation from checks (org, label, url, allowed) and roots (org, allowed)."""
    own = F.element_at(F.split("label", "/"), -1).isin(*OWN_STAGES)
    paths = checks.groupBy("org").agg(F.count(F.lit(1)).alias("paths"), F.count_if("allowed").alias("open"), F.count_if(own).alias("own"))
    heads = roots.groupBy("org").agg(F.bool_or("allowed").alias("root"))
    rows = paths.join(heads, "org", "full").na.fill(0, ["paths", "open", "own"]).na.fill(False, ["root"])
    shut = F.when(F.col("root"), "paths").otherwise("blocked")
    verdict = (
        F.when((F.col("paths") > 0) & (F.col("own") == 0), "korea_only")
        .when(F.col("paths") == 0, shut)
        .when(F.col("open") == F.col("paths"), "full")
        .when(F.col("open") > 0, "partial")
        .otherwise(shut)
    )
    return rows.select("org", "paths", F.col("open").alias("allowed"), verdict.alias("verdict"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """(verdict, label, n), blocked organisations first."""
    labels = F.create_map(*(F.lit(x) for kv in rules.VERDICT_LABELS.items() for x in kv))
    counts = verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((F.col("verdict") != "blocked").alias("open"), F.col("verdict").alias("name"))
    # A row for each of five verdicts.
    return counts.select("verdict", F.element_at(labels, F.col("verdict")).alias("label"), "n", F.row_number().over(Window.orderBy(order)).alias("pos"))


def by_route(attempts: DataFrame) -> DataFrame:
    """(src_idx, category, route, stage, n_rows, trail, ok) of routes tried one by one.

    ``attempts`` have ``route`` besides what ``tried`` needs; the press feed is route -1 and
    is asked only by sources none of whose press routes gave rows.
    """
    keys = ("src_idx", "category", "route")
    ok = F.col("robots_ok") & F.col("fetched") & (F.col("n_rows") > 0)
    own = attempts.withColumn("ok", ok)
    press = own.where((F.col("category") == rules.KOREA_CATEGORY) & (F.col("route") >= 0) & F.col("ok")).select("src_idx").distinct()
    asked = own.where("route >= 0").unionByName(own.where("route < 0").join(press, "src_idx", "left_anti"))
    first = F.min(F.when(F.col("ok"), F.col("stage_ord"))).over(Window.partitionBy(*keys))
    made = asked.withColumn("winner", first).where("winner is null or stage_ord <= winner")
    said = F.concat("stage", F.lit(": "), F.when(F.col("ok"), F.concat(F.col("n_rows").cast("string"), F.lit("건"))).otherwise(reason()))
    # A route has a few stages, so its attempts may be gathered.
    trail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("stage_ord").alias("o"), said.alias("t")))), lambda x: x["t"]), " → ")
    win = F.max(F.when(F.col("ok"), F.struct("stage", "n_rows")))
    out = made.groupBy(*keys).agg(trail.alias("trail"), win.alias("w"))
    return out.select(*keys, F.coalesce("w.stage", F.lit("")).alias("stage"), F.coalesce("w.n_rows", F.lit(0)).alias("n_rows"), "trail", F.col("w").isNotNull().alias("ok"))


def failures(results: DataFrame) -> DataFrame:
    """(src_idx, category, trails) of categories none of whose routes gave rows."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("route", "trail"))), lambda x: x["trail"]), " / ")
    return results.groupBy("src_idx", "category").agg(F.bool_or("ok").alias("ok"), text.alias("trails")).where("not ok").drop("ok")


def contributing(kept: DataFrame, routes: DataFrame) -> DataFrame:
    """The routes (src_idx, route) of which a kept notice came."""
    return routes.join(kept.select("src_idx", "route").distinct(), ["src_idx", "route"], "left_semi")


def failure_reasons(attempts: DataFrame) -> DataFrame:
    """(reason, n): how often each reason ended an attempt, most frequent first by n, name."""
    return tried(attempts).where("not ok").groupBy(reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))
