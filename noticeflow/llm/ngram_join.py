"""N-gram Jaccard join: near duplicates by shingle sets, exactly, as a size-aware join.

A document is the set of its distinct five-word shingles (A-Z lower-cased; with fewer
words, the word sequence is the one shingle; without words the set is empty and linked
with nothing).  Two documents link when their Jaccard similarity reaches the threshold.
The result says, for each row, the size of its set and the component that it belongs to.

1. Equal sets become one class, known by its least id.
2. Small sets, up to a boundary ``x``: for each overlap ``c`` that two small sets may need,
   every subset of size ``c`` is a key.  Two sets that share such a key and need no more
   than ``c`` are linked, and they are linked with the smallest set under the key as well.
3. Large sets: inverted lists.  In a fixed total order of the shingles (frequent ones
   last), two sets that link share one of the first ``n - ceil(t*n) + 1`` shingles, so
   only these are listed.
4. The boundary is the one of least cost: keys of the small sets against postings of the
   large ones times the mean length of the lists they scan, both measured on all rows.
5. The lists of the final order come as sorted rows.  Short ones are scanned for the number
   ``k`` of first-part shingles that two sets share; if two sets share no long list, they can
   link only if ``k`` and what lies beyond a first part reach the least overlap, which rules
   out most sets that merely share a passage.  Long lists, and the keys of small sets, are
   stars around one set and rule nothing out.  No list is gathered: a long one goes out row
   by row, and one that a task meets often among its own postings never goes to one task.
6. What is left forms candidate clusters.  A cluster that fits into a block is dealt to one,
   where all inverted lists of its sets are scanned to count the overlap of every pair,
   exactly.  Of a larger cluster the candidate edges are verified first, each exactly, which
   joins a group of near copies in linear work.  Then only parts of sets that are not joined
   yet, and whose sizes allow a link, meet in blocks: sizes fall in bands of a factor of the
   threshold, and linked sets lie in one band or in neighbours.  Only a spanning star of the
   links leaves a block.

A row without an id links with nothing but equal sets; its component is theirs, or null.
Rows of one id with different texts are judged each by its own text, under that id.  An
empty table gives an empty result.  Texts of any length are read whole; a block holds at
least one set, however large.  Columns other than id and text are not looked at.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import textvec as tv
from noticeflow.llm.components import components, forest, told
from noticeflow.llm.storage import drop, written

_SIZE, _LIST = 0, 1
#: So many parts of all large clusters, some tens of bytes each, may be broadcast.
MOST_PARTS = 20_000
#: So many words of marks, 64 ids' hashes each, may be broadcast: some tens of bytes each.
MOST_WORDS = 500_000


@dataclass(frozen=True)
class Join:
    """Shingle width, threshold in percent, and the sizes of the work units.

    ``frequent``: a shingle in more first parts than this comes last in the order;
    ``max_frequent``: so many of them at most, the most frequent;
    ``largest_small``: the boundary is at most this; ``short``: longest list that is scanned
    for pairs; ``hot``: a list that a task meets so often in a million postings stays spread;
    ``max_broadcast``: rows of long lists that may be broadcast, else they are
    joined; ``block``: weight of a block.
    """

    k: int = 5
    percent: int = 80
    frequent: int = 64
    max_frequent: int = 100_000
    largest_small: int = 12
    short: int = 128
    hot: int = 8
    max_broadcast: int = 1_000_000
    block: int = 1_000_000

    def need(self, a: int, b: int) -> int:
        """Least overlap of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def first(self, n: int) -> int:
        """How many of n ordered shingles are listed."""
        return n - -(-self.percent * n // 100) + 1

    def overlaps(self, n: int, x: int) -> list[int]:
        """Overlaps that a set of size n may need with a set of size up to x."""
        sizes = range(max(1, -(-self.percent * n // 100)), min(x, 100 * n // self.percent) + 1)
        return sorted({self.need(n, b) for b in sizes if self.need(n, b) <= min(n, b)})

    def keys(self, n: int, x: int) -> int:
        return sum(math.comb(n, c) for c in self.overlaps(n, x))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _count(conf: Join):
    """Per partition: set sizes up to twice the boundary, and shingles of first parts."""

    def flush(held: list[np.ndarray], sizes: np.ndarray) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        small = np.flatnonzero(sizes)
        kind = np.concatenate((np.full(len(small), _SIZE), np.full(len(value), _LIST))).astype(np.int32)
        return pa.record_batch(
            [pa.array(kind), _longs(np.concatenate((small.astype(np.uint64), value))), pa.array(np.concatenate((sizes[small], n)).astype(np.int64))],
            names=["kind", "value", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, sizes = [], 0, np.zeros(2 * conf.largest_small + 1, np.int64)
        for batch in batches:
            for chunk in tv.chunks(batch.column(0)):
                for s in tv.shingle_sets(chunk, conf.k):
                    if len(s):
                        sizes[min(len(s), len(sizes) - 1)] += 1
                        held.append(s[: conf.first(len(s))])
                        total += len(held[-1])
                if total > 1_000_000:
                    yield flush(held, sizes)
                    held, total, sizes = [], 0, np.zeros_like(sizes)
        yield flush(held, sizes)

    return run


def boundary(conf: Join, sizes: dict[int, int], scan: float) -> int:
    """The boundary of least cost; ``scan`` is the mean length of a list met by a posting."""

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= x:
                total += count * conf.keys(n, x)
            if 100 * n > conf.percent * x:
                total += count * conf.first(n) * scan
        return total

    return min(range(conf.largest_small + 1), key=cost)


def _signatures(conf: Join, x: int, frequent: np.ndarray, more: tuple[str, ...] = ()):
    """Rows (doc_id, n, d1, d2, first, keys) of each document: its first part, and the subset
    keys of a small set."""
    none = np.zeros(0, np.uint64)

    def subsets(s: np.ndarray) -> np.ndarray:
        out = []
        for c in conf.overlaps(len(s), x) if len(s) <= x else ():
            mark = np.uint64(c * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            picked = s[np.array(list(itertools.combinations(range(len(s)), c)))]
            out.append(tv.mix(np.bitwise_xor.reduce(tv.mix(picked + mark), axis=1) + mark))
        return np.concatenate(out) if out else none

    def first(s: np.ndarray) -> np.ndarray:
        if 100 * len(s) <= conf.percent * x:
            return none
        p = conf.first(len(s))
        if not len(frequent):
            return s[:p]
        last = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
        return np.concatenate((s[~last][:p], s[last]))[:p]

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        at = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), _longs(np.concatenate([none, *values])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tv.chunks(batch.column(1)):
                sets = tv.shingle_sets(chunk, conf.k)
                firsts = [first(s) for s in sets]
                d1 = np.array([np.bitwise_xor.reduce(tv.mix(s)) if len(s) else 0 for s in sets], np.uint64)
                d2 = np.array([np.add.reduce(tv.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else 0 for s in sets], np.uint64)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(chunk.first, chunk.rows),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _longs(d1),
                        _longs(d2),
                        lists(firsts),
                        lists([subsets(s) if len(s) else s for s in sets]),
                        *(batch.column(2 + i).slice(chunk.first, chunk.rows) for i in range(len(more))),
                    ],
                    names=["doc_id", "n", "d1", "d2", "first", "keys", *(f"_more{i}" for i in range(len(more)))],
                )

    return run


def _sets(conf: Join):
    """(block list, doc_id, bytes of the set) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tv.chunks(batch.column(2)):
                values = [s.tobytes() for s in tv.shingle_sets(chunk, conf.k)]
                yield pa.record_batch(
                    [batch.column(0).slice(chunk.first, chunk.rows), batch.column(1).slice(chunk.first, chunk.rows), pa.array(values, pa.binary())],
                    names=["blocks", "doc_id", "shingles"],
                )

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix whose upper half has the overlap of each pair, by scanning inverted lists."""
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    shingle = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    new = np.concatenate(([True], shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    length = np.diff(np.concatenate((begin, [len(shingle)])))
    for b, n in zip(begin[length > 64], length[length > 64], strict=True):
        own = owner[b : b + n]
        out[np.ix_(own, own)] += 1
    short = (length > 1) & (length <= 64)
    at, left = begin[short], length[short]
    places = np.repeat(at + left, left) - np.concatenate([np.arange(n, 0, -1) for n in left]) if len(at) else np.zeros(0, np.int64)
    ends = np.repeat(at + left, left)
    for step in range(1, 64):
        keep = places + step < ends
        places, ends = places[keep], ends[keep]
        if not len(places):
            break
        np.add.at(out, (owner[places], owner[places + step]), 1)
    return out


def _links(conf: Join):
    """The links of a block, as stars: (doc_id, least doc_id reachable in the block)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        docs = table["doc_id"].to_numpy()
        ordered = [np.frombuffer(raw, np.uint64) for raw in table["shingles"].to_pylist()]
        size = np.array([len(s) for s in ordered], np.int64)
        common = overlaps(ordered)
        a, b = np.nonzero(np.triu(common, 1))
        k = common[a, b]
        linked = (100 + conf.percent) * k >= conf.percent * (size[a] + size[b])
        stars = [(x, r) for x, r in forest(zip(docs[a[linked]].tolist(), docs[b[linked]].tolist(), strict=True)).items() if x != r]
        return pa.table({"u": pa.array([x for x, _ in stars], pa.int64()), "v": pa.array([r for _, r in stars], pa.int64())})

    return run


def _hot(conf: Join):
    """(t, n) of shingles that one task meets ``hot`` times or more among its next postings."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
        often = n >= conf.hot
        return pa.record_batch([pa.array(value[often]), pa.array(n[often].astype(np.int64))], names=["t", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            total += len(held[-1])
            if total > 1_000_000:
                yield flush(held)
                held, total = [], 0
        yield flush(held)

    return run


_PAIRS = "a long, b long, na long, nb long, k long"


def _scan(conf: Join):
    """(a, b, na, nb, k) of sets on short lists; (doc, first doc, 0, 0, -1) of long ones.

    Rows (t, doc_id, n) come sorted, so a list is rows in a run: it is held while it is short,
    and from then on each of its rows goes out as it comes.
    """
    names = ["a", "b", "na", "nb", "k"]

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64)
        order = np.lexsort((pairs[1], pairs[0]))
        pairs = pairs[:, order]
        new = np.flatnonzero(np.concatenate(([True], (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])))) if len(order) else order
        k = np.diff(np.concatenate((new, [len(order)])))
        return pa.record_batch([*(pa.array(c) for c in pairs[:, new]), pa.array(k.astype(np.int64))], names=names)

    def star(docs: np.ndarray, hub: int) -> pa.RecordBatch:
        zero = np.zeros(len(docs), np.int64)
        return pa.record_batch([pa.array(x) for x in (docs, np.full(len(docs), hub), zero, zero, zero - 1)], names=names)

    def pairs(docs: np.ndarray, n: np.ndarray, begin: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """Pairs of all lists of one size at once, some lists at a time."""
        i, j = np.triu_indices(size, 1)
        step = max(1, 500_000 // len(i))
        for lo in range(0, len(begin), step):
            at = begin[lo : lo + step, None]
            x, y = (at + i).ravel(), (at + j).ravel()
            near = (100 * np.minimum(n[x], n[y]) >= conf.percent * np.maximum(n[x], n[y])) & (docs[x] != docs[y])
            if near.any():
                yield np.stack((docs[x[near]], docs[y[near]], n[x[near]], n[y[near]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        rest = np.zeros((3, 0), np.int64)
        long_, hub = None, 0

        def lists(rows: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
            for m in np.unique(size[(size > 1) & (size <= conf.short)]).tolist():
                yield from pairs(rows[1], rows[2], begin[size == m], m)

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)])
            if long_ is not None:
                more = int(np.searchsorted(rows[0], long_, "right"))
                yield star(rows[1, :more], hub)
                rows = rows[:, more:]
                if not rows.shape[1]:
                    continue
                long_ = None
            rows = np.concatenate((rest, rows), axis=1)
            begin = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))) if rows.shape[1] else np.zeros(0, np.int64)
            size = np.diff(np.concatenate((begin, [rows.shape[1]])))
            for at, m in zip(begin[size > conf.short].tolist(), size[size > conf.short].tolist(), strict=True):
                yield star(rows[1, at : at + m], int(rows[1, at]))
            # The last list may go on in the next batch.
            if len(begin) and size[-1] > conf.short:
                long_, hub, rest = int(rows[0, -1]), int(rows[1, begin[-1]]), rows[:, :0]
            elif len(begin):
                rest = rows[:, begin[-1] :]
            for found in lists(rows, begin[:-1], size[:-1]):
                held.append(found)
                total += found.shape[1]
                if total > 1_000_000:
                    yield flush(held)
                    held, total = [], 0
        held += lists(rest, np.zeros(1, np.int64), np.array([rest.shape[1]]))
        yield flush(held)

    return run


def _candidates(marks: DataFrame, conf: Join) -> DataFrame:
    """Pairs (u, v) that may link, and stars around one set for long lists and subset keys."""
    postings = marks.select("doc_id", "n", F.explode("first").alias("t"))
    hot = written(marks.select("first").mapInArrow(_hot(conf), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") > conf.short), "hot-lists")
    few = hot.count() <= conf.max_broadcast
    about = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    hubs = written(postings.join(about(hot.select("t")), "t").groupBy("t").agg(F.min("doc_id").alias("hub")), "long-lists")
    if few:
        known = postings.join(F.broadcast(hubs), "t", "left")
        stars = known.where("hub is not null").select(F.col("doc_id").alias("u"), F.col("hub").alias("v"))
        rest = known.where("hub is null")
    else:
        stars = postings.join(hubs, "t").select(F.col("doc_id").alias("u"), F.col("hub").alias("v"))
        rest = postings.join(hubs.select("t"), "t", "left_anti")

    keyed = marks.where("size(keys) > 0").select("doc_id", "n", F.explode("keys").alias("t"))
    least = keyed.groupBy("t").agg(F.min(F.struct("n", "doc_id")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    total = least.agg(F.sum("n")).head()[0] or 0
    small = told(keyed.drop("n"), least, "t", total).select(F.col("doc_id").alias("u"), F.col("hub.doc_id").alias("v"))

    # Python gets each list as a run of rows; a list in one task is no longer than what _hot lets pass.
    scanned = rest.select("t", "doc_id", "n").repartition("t").sortWithinPartitions("t", "doc_id").mapInArrow(_scan(conf), _PAIRS)
    star = F.min("k").alias("star")
    pairs = scanned.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum(F.greatest("k", F.lit(0))).alias("k"), star)
    # n less ceil(percent * n / 100) and one, are in the first part; the rest is beyond it.
    beyond = F.expr(f"greatest((na * {conf.percent} + 99) div 100, (nb * {conf.percent} + 99) div 100) - 1")
    may = (100 + conf.percent) * (F.col("k") + beyond) >= conf.percent * (F.col("na") + F.col("nb"))
    near = pairs.where((F.col("star") < 0) | may).select(F.col("a").alias("u"), F.col("b").alias("v"))
    out = written(stars.unionByName(small).unionByName(near).where("u <> v").distinct(), "candidates")
    drop(marks.sparkSession, hot, hubs)
    return out


def _verify(conf: Join):
    """Of rows (u, v, their sets) those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(raw, np.uint64) for raw in batch.column(i).to_pylist()] for i in (2, 3)]
            linked = [
                (100 + conf.percent) * len(np.intersect1d(a, b, assume_unique=True)) >= conf.percent * (len(a) + len(b)) for a, b in zip(*sets, strict=True)
            ]
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return run


def _settle(edges: DataFrame, big: DataFrame, sets: DataFrame, conf: Join) -> DataFrame:
    """The links among candidate edges of the clusters in ``big`` (node, root), verified.

    Sets of hubs are copied once for each ``share`` of their edges, so no task gets them all.
    """
    share = 2_000
    own = edges.join(big.select(F.col("node").alias("u")), "u", "left_semi")
    hubs = own.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = hubs.agg(F.sum("n")).head()[0] or 0
    dealt = told(own, hubs.withColumn("salts", F.ceil(F.col("n") / share).cast("int")), "v", total).withColumn("salt", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int"))
    copies = hubs.select("v", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / share).cast("int") - 1)).alias("salt"))
    right = copies.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")
    left = dealt.select("u", "v", "salt").join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u")
    return left.join(right, ["v", "salt"]).select("u", "v", "a", "b").mapInArrow(_verify(conf), "u long, v long")


def _blocks(nodes: DataFrame, weights: DataFrame, conf: Join) -> DataFrame:
    """(blocks, doc_id) of clusters that fit into a block; smaller ones share one."""
    fits = weights.where(F.col("w") <= conf.block)
    total = fits.agg(F.sum("w")).head()[0] or 0
    home = F.concat(F.lit("h"), F.pmod(F.xxhash64("root"), F.lit(max(1, -(-total // conf.block)))))
    block = F.when(F.col("w") > conf.block // 8, F.concat(F.lit("r"), "root")).otherwise(home)
    return nodes.join(fits, "root").select(F.array(block).alias("blocks"), F.col("node").alias("doc_id"))


def _cross_blocks(big: DataFrame, settled: DataFrame, conf: Join) -> DataFrame:
    """(blocks, doc_id) of larger clusters, so that all sets meet that are not joined yet.

    A part is a share of one large group of joined sets, or of all small groups, in one band
    of sizes.  Parts of the same group need not meet; nor do parts of bands further apart.
    """
    half = conf.block // 2
    rows = big.join(settled, "node", "left").withColumn("group", F.coalesce("found", "node"))
    rows = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(100.01 / conf.percent))).cast("int"))
    size = rows.groupBy("root", "band", "group").agg(F.sum("weight").alias("w"))
    label = F.when(F.col("w") > half, F.col("group").cast("string")).otherwise("*")
    labels = size.withColumn("label", label)
    parts = labels.groupBy("root", "band", "label").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("groups")).withColumn("parts", F.ceil(F.col("w") / half).cast("int"))
    # Large groups are few, by their weight, and parts lists by the clusters': a group's many
    # rows then learn its name without meeting in one task.
    named = labels.where("label <> '*'").select("root", "band", "group", "label")
    few = parts.count() <= MOST_PARTS
    told_ = lambda df: F.broadcast(df) if few else df
    # A cluster has as many parts as blocks of half size, and a few for its bands.
    lists = parts.groupBy("root").agg(F.collect_list(F.struct("band", "label", "parts", "groups")).alias("all"))
    own = rows.join(told_(named), ["root", "band", "group"], "left").withColumn("label", F.coalesce("label", F.lit("*")))
    own = own.join(told_(parts.select("root", "band", "label", "parts")), ["root", "band", "label"])
    own = own.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(told_(lists), "root")
    name = lambda band, label, part: F.concat_ws(":", band.cast("string"), label, part.cast("string"))
    mine = name(F.col("band"), F.col("label"), F.col("part"))
    meets = F.filter("all", lambda x: (F.abs(x["band"] - F.col("band")) <= 1) & ((x["label"] == "*") | (x["label"] != F.col("label"))))
    each = F.flatten(F.transform(meets, lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda j: name(x["band"], x["label"], j))))
    blocks = F.transform(each, lambda other: F.concat_ws("/", F.col("root").cast("string"), F.least(other, mine), F.greatest(other, mine)))
    return own.select(blocks.alias("blocks"), F.col("node").alias("doc_id")).where("size(blocks) > 0")


_SETS = "blocks array<string>, doc_id long, shingles binary"


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` joined with ``ids`` (doc_id and more), which is read three times.

    Texts of other ids are left out before the shuffle, but for those (about one in eight, more
    where ids are more than four million) whose hash is marked by an id; the join drops them.
    """
    words = min(MOST_WORDS, max(1, ids.count() // 8))
    at = f"pmod(xxhash64(doc_id), {64 * words}L)"
    marked = ids.selectExpr(f"{at} div 64 AS _word", f"shiftleft(1L, CAST({at} % 64 AS INT)) AS _bit")
    bits = F.broadcast(marked.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    near = docs.withColumn("_word", F.expr(f"{at} div 64")).join(bits, "_word").where(f"getbit(_bits, CAST({at} % 64 AS INT)) = 1")
    return near.drop("_word", "_bits").join(ids, "doc_id")


def _linked(docs: DataFrame, placed: DataFrame, conf: Join) -> DataFrame:
    """The links that are found in blocks, for documents (blocks, doc_id)."""
    texts = _texts(docs, placed).select("blocks", "doc_id", "text")
    sets = texts.mapInArrow(_sets(conf), _SETS).select(F.explode("blocks").alias("block"), "doc_id", "shingles")
    return sets.groupBy("block").applyInArrow(_links(conf), "u long, v long")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", conf: Join = Join(), more: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id, component_id, and the
    columns that ``more`` names."""
    spark = docs.sparkSession
    kinds = "".join(f", _more{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(more))
    carried = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *more)
    docs = carried.select("doc_id", "text")

    counts = docs.select("text").mapInArrow(_count(conf), "kind int, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    counts = written(counts.where(f"kind = {_SIZE} or n > 1"), "list-sizes")
    sizes = {r["value"]: r["n"] for r in counts.where(f"kind = {_SIZE} and value < {2 * conf.largest_small}").collect()}
    lists = counts.where(f"kind = {_LIST}")
    scan = lists.agg(F.sum(F.col("n") * F.col("n").cast("double")) / F.sum("n")).head()[0] or 1.0
    often = lists.where(F.col("n") > conf.frequent).orderBy(F.desc("n"), "value").limit(conf.max_frequent).select("value")
    frequent = np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))
    drop(spark, counts)
    x = boundary(conf, sizes, scan)

    schema = "doc_id long, n long, d1 long, d2 long, first array<long>, keys array<long>" + kinds
    marks = written(carried.mapInArrow(_signatures(conf, x, frequent, more), schema), "signatures")
    extra = [f"_more{i}" for i in range(len(more))]
    rows = written(marks.select("doc_id", "n", "d1", "d2", *extra), "rows")
    classes = rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = classes.select(F.col("rep").alias("doc_id"))
    # Read by several steps, each of which would shuffle the lists again.
    parts = written(marks.select("doc_id", "n", "first", "keys").join(reps, "doc_id", "left_semi"), "first-parts")
    drop(spark, marks)
    edges = _candidates(parts, conf)
    drop(spark, parts)
    clusters = written(components(edges), "clusters")

    sizes_of = rows.where("n > 0").groupBy(F.col("doc_id").alias("node")).agg(F.max("n").alias("n"))
    nodes = written(clusters.join(sizes_of, "node").withColumn("weight", F.col("n") + 512), "nodes")
    weights = nodes.groupBy("root").agg(F.sum("weight").alias("w"))
    placed = written(_blocks(nodes, weights, conf), "placed")
    links = _linked(docs, placed, conf)
    large = written(nodes.join(weights.where(F.col("w") > conf.block).select("root"), "root"), "large")
    spare = []
    if not large.isEmpty():
        sets = written(_texts(docs, large.select(F.col("node").alias("doc_id"))).select(F.lit(None).cast("array<string>").alias("blocks"), "doc_id", "text").mapInArrow(_sets(conf), _SETS), "sets")
        first = written(_settle(edges, large, sets, conf), "settled")
        joined = written(components(first).withColumnRenamed("root", "found"), "joined")
        cross = _cross_blocks(large, joined, conf).join(sets.select("doc_id", "shingles"), "doc_id").select(F.explode("blocks").alias("block"), "doc_id", "shingles")
        links = links.unionByName(first).unionByName(cross.groupBy("block").applyInArrow(_links(conf), "u long, v long"))
        spare = [sets, first, joined]
    links = written(links, "links")
    found = written(components(links), "found")
    drop(spark, links, edges, clusters, nodes, placed, large, *spare)

    salts = 16
    groups = (
        classes.where("copies > 1")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("n", "d1", "d2", F.col("rep").alias("_rep"), F.coalesce("root", "rep").alias("_group"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .join(groups, ["n", "d1", "d2", "salt"], "left")
        .join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("_rep", "doc_id").alias("class_id"),
            F.coalesce("_group", "root", "doc_id").alias("component_id"),
            *(F.col(e).alias(c) for e, c in zip(extra, more, strict=True)),
        )
    )
