"""Order-dependent selections as parallel rounds: who comes first wins, without gathering.

A sequential scan that keeps an item unless an earlier kept item excludes it gives the
first independent set in that order.  In each round the items all of whose earlier rivals
are decided decide themselves; the number of rounds is the longest chain of such waits, not
the number of items.  Rounds go on until all are decided; a caller's own limit on them is an
error when it is met.  Rounds are written to the shared folder.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.storage import drop, written


def _open(now: DataFrame, done: int, rounds: int | None) -> bool:
    """Whether another round is needed after this one."""
    left = not now.where("state = 0").isEmpty()
    if left and rounds is not None and done >= rounds:
        raise RuntimeError(f"rows are still undecided after {rounds} rounds")
    return left


def keep_first(rows: DataFrame, keys: Column, order: Column, rounds: int | None = None) -> DataFrame:
    """Rows kept by a scan in ``order`` that drops a row if any of its keys was kept before.

    ``keys`` is an array (nulls and duplicates in it do not count); only kept rows add
    their keys.  Each round is one aggregate per key, so groups of rows that share a key
    are never paired or gathered.  ``order`` must be unique.
    """
    own = F.coalesce(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())), F.array())
    now = written(rows.select(order.alias("at"), own.alias("keys"), F.when(F.size(own) == 0, 1).otherwise(0).alias("state")), "greedy")
    for done in count(1):
        each = now.select("at", "state", F.explode("keys").alias("key"))
        heads = each.groupBy("key").agg(F.min(F.when(F.col("state") == 1, F.col("at"))).alias("kept"), F.min(F.when(F.col("state") == 0, F.col("at"))).alias("open"))
        seen = each.where("state = 0").join(heads, "key").groupBy("at").agg(F.bool_or(F.col("kept").isNotNull()).alias("lost"), F.bool_and(F.col("open") == F.col("at")).alias("first"))
        state = F.when(F.col("state") != 0, F.col("state")).when(F.col("lost"), 2).when(F.col("first"), 1).otherwise(0)
        after = written(now.join(seen, "at", "left").select("at", "keys", state.alias("state")), "greedy")
        drop(rows.sparkSession, now)
        now = after
        if not _open(now, done, rounds):
            break
    kept = now.where("state = 1").select(F.col("at").alias("_at"))
    return rows.withColumn("_at", order).join(kept, "_at", "left_semi").drop("_at")


def _first_leaders(classes: DataFrame, edges: DataFrame, rounds: int | None) -> DataFrame:
    """Ids of the classes that lead: no earlier leader is near. Edges go (earlier, later)."""
    now = written(classes.select("id", F.lit(0).alias("state")), "leaders")
    for done in count(1):
        rivals = edges.join(now.withColumnRenamed("id", "earlier").withColumnRenamed("state", "rival"), "earlier")
        seen = rivals.groupBy(F.col("later").alias("id")).agg(F.max((F.col("rival") == 1).cast("int")).alias("led"), F.max((F.col("rival") == 0).cast("int")).alias("waits"))
        state = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("led", F.lit(0)) == 1, 2).when(F.coalesce("waits", F.lit(0)) == 0, 1).otherwise(0)
        after = written(now.join(seen, "id", "left").select("id", state.alias("state")), "leaders")
        drop(classes.sparkSession, now)
        now = after
        if not _open(now, done, rounds):
            break
    return now.where("state = 1").select("id")


def near_sets(sets: DataFrame) -> DataFrame:
    """(a, b) of distinct token sets (id, tokens) with twice the overlap at least the union.

    Sets of similarity one half share one of their rarest n - ceil(n/2) + 1 tokens, so only
    those are indexed, rarest first by the counts of the whole table.
    """
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = sets.select("id", F.explode("tokens").alias("token")).join(counts, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    heads = ranked.select("id", F.size("t").alias("n"), F.explode(F.slice("t", F.lit(1), F.size("t") - F.ceil(F.size("t") / 2).cast("int") + 1)).alias("h")).select("id", "n", F.col("h.token").alias("token"))
    other = heads.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("token").alias("_t"))
    pairs = heads.join(other, (F.col("token") == F.col("_t")) & (F.col("id") < F.col("b")) & (2 * F.col("m") >= F.col("n")) & (2 * F.col("n") >= F.col("m")))
    pairs = pairs.select(F.col("id").alias("a"), "b").distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    sized = pairs.join(left, "a").join(right, "b").withColumn("k", both).withColumn("u", F.size("ta") + F.size("tb") - F.col("k"))
    return sized.where("2 * k >= u").select("a", "b", "k", "u")


def _tokens(within: str | None) -> Column:
    tokens = T.title_tokens(F.col("title"))
    return tokens if within is None else F.transform(tokens, lambda t: F.concat_ws("\x1e", t, F.col(within)))


def clusters(notices: DataFrame, rounds: int | None = None, within: str | None = None) -> DataFrame:
    """``notices`` (src_idx, item_idx unique) with leader_src, leader_item: leader clustering.

    In the order of date (newest first, none last), title and source, an item joins the most
    similar earlier leader of similarity one half or more, the earliest of equals, or leads
    itself.  Titles with the same tokens are one class: only its first item can lead, so
    leaders are found among classes, and every other item then looks among those before it.
    Titles without tokens lead themselves.  With ``within`` only rows that are equal in that
    column meet: it is one more part of each token, so other rows share none.
    """
    day = F.coalesce(F.date_diff(F.lit("9999-12-31").cast("date"), F.col("published")), F.lit(2**31 - 1))
    at = F.struct(day.alias("day"), F.col("title").alias("title"), F.col("src_idx").alias("src"), F.col("item_idx").alias("item"))
    rows = notices.withColumn("_at", at).withColumn("_tokens", F.array_sort(_tokens(within)))
    rows = rows.withColumn("_id", F.sha2(F.concat_ws("\x1f", "_tokens"), 256))
    items = rows.where(F.size("_tokens") > 0)
    classes = written(items.groupBy(F.col("_id").alias("id")).agg(F.min("_at").alias("at"), F.first("_tokens").alias("tokens")), "classes")
    edges = written(near_sets(classes.select("id", "tokens")), "near")
    heads = classes.select("id", "at")
    dated = edges.join(heads.toDF("a", "ra"), "a").join(heads.toDF("b", "rb"), "b")
    swap = F.col("ra") < F.col("rb")
    directed = dated.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("earlier"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("later"))
    leaders = written(_first_leaders(heads, written(directed, "directed"), rounds).join(heads, "id"), "leading")
    both = edges.select("a", "b", "k", "u").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "k", "u"))
    own = heads.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1).alias("k"), F.lit(1).alias("u"))
    options = both.unionByName(own).join(leaders.toDF("b", "rl"), "b").select(F.col("a").alias("_id"), "rl", "k", "u")
    met = items.select("_id", "_at").join(options, "_id").where("rl <= _at")
    best = met.groupBy("_at").agg(F.min_by("rl", F.struct((-F.col("k") / F.col("u")).alias("s"), F.col("rl"))).alias("lead"))
    return (
        rows.join(best, "_at", "left")
        .withColumn("leader_src", F.coalesce("lead.src", "src_idx"))
        .withColumn("leader_item", F.coalesce("lead.item", "item_idx"))
        .drop("_at", "_tokens", "_id", "lead")
    )
