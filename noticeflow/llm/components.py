"""Connected components of an edge table, by alternating large-star and small-star rounds.

Edges never leave the executors.  Each round is written to the shared folder, so lineage
stays short and a lost executor costs one round at most.  Hubs, nodes with more edges than
a share of all that has a floor, are few by that count; what edges have to learn about them
is broadcast, so no task gets all edges of a hub.

Before the rounds, tasks of a bounded number of edges each join what they can by union-find,
which leaves a forest.  If one such task holds all edges, that is the answer; else what is
left of the trees is joined by the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.storage import drop, written


def forest(pairs) -> dict[int, int]:
    """node -> least node of its component, by union-find, for the pairs given."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars around the least node."""
    a, b = [], []
    for batch in batches:
        a += batch.column(0).to_pylist()
        b += batch.column(1).to_pylist()
    stars = [(x, r) for x, r in forest(zip(a, b, strict=True)).items() if x != r]
    yield pa.record_batch([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], names=["u", "v"])


#: Edges that one task joins by union-find: some tens of bytes each.
SHARE = 100_000
#: A node with more edges than this, and than one in HUBS of all edges, is a hub.
FEW, HUBS = 1_000, 20_000


def told(edges: DataFrame, about: DataFrame, key: str, total: int) -> DataFrame:
    """``edges`` joined with ``about`` (key, n and more; key unique; n: its edges), without n.

    The hubs are at most HUBS rows, so they may be broadcast.
    """
    least = max(FEW, total // HUBS)
    hubs, others = about.where(F.col("n") > least).drop("n"), about.where(F.col("n") <= least).drop("n")
    return edges.join(F.broadcast(hubs), key).unionByName(edges.join(others, key))


def _rounds(now: DataFrame, rounds: int | None) -> DataFrame:
    """Stars around the least nodes, from edges (u, v); they are dropped."""
    seen = None
    for done in count(1):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head()
        if state == seen:
            return now
        if rounds is not None and done > rounds:
            raise RuntimeError(f"components still change after {rounds} rounds")
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * state[0]
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = told(both.where("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        star = told(large, low, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(star.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(now.sparkSession, now)
        now = after


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) for each node that has an edge; root is the least node it can reach.

    ``edges`` has two long columns.  Loops and repeated edges are allowed.  No edges: no rows.
    Rounds go on until nothing changes; a limit on them is an error when it is met.
    """
    a, b = edges.columns
    small = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    first = written(small.mapInArrow(_local, "u long, v long"), "edges")
    tasks = -(-first.count() // SHARE)
    now = written(first.coalesce(max(tasks, 1)).mapInArrow(_local, "u long, v long"), "edges")
    drop(edges.sparkSession, first)
    if tasks > 1:
        now = _rounds(now, rounds)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
