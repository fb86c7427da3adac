"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are compared with A-Z lower-cased and ASCII punctuation as white space.  Every n-gram
of an item is a seed, common or rare, as those that an edited copy keeps may be any of them.
A passage that holds enough seeds of an item is aligned with it, unless too few of the
item's words are in it for the threshold; the score is the local alignment score over that
of the item with itself.

Items are taken in blocks of bounded size, each against all documents; the seeds of one
block are all that is sent to the executors, and texts are never moved.

Null and empty texts match nothing; items without words are passed over.  Items shorter
than the seed length are one seed.  Rows are judged one for one: a repeated document gives
its rows again, and so does a repeated item.  Of passages that score alike the first counts.
Other columns are not looked at.  An empty side gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import textvec as tv

PLAIN = tv.LOWER.copy()
PLAIN[[ord(c) for c in string.punctuation]] = 0x20


@dataclass(frozen=True)
class Align:
    """Seed length, seeds that a passage needs, and scores."""

    n: int = 3
    seeds: int = 2
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.5
    block: int = 20_000


def smith_waterman(a: np.ndarray, b: np.ndarray, conf: Align = Align()) -> tuple[int, int]:
    """(best local score, end in b); a row of the matrix at a time, gaps by a running maximum."""
    step = -conf.gap
    ramp = np.arange(len(b)) * step
    above = np.zeros(len(b) + 1, np.int64)
    best, end = 0, 0
    for x in a:
        row = np.maximum(above[:-1] + np.where(b == x, conf.match, conf.mismatch), np.maximum(above[1:] - step, 0))
        row = np.maximum.accumulate(row + ramp) - ramp
        above = np.concatenate(([0], row))
        at = int(row.argmax()) if len(row) else 0
        if len(row) and row[at] > best:
            best, end = int(row[at]), at + 1
    return best, end


def _grams(chunk: tv.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes and first words; a row with fewer words has one, of all its words."""
    value, first = tv.ngrams(chunk, n)
    short = np.flatnonzero((chunk.per_row > 0) & (chunk.per_row < n))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(chunk.per_row)))
        total = [tv.mix(np.array([np.add.reduce(tv.mix(chunk.hashes[begin[r] : begin[r + 1]] + np.uint64(7)))], np.uint64))[0] for r in short]
        value, first = np.concatenate((value, np.array(total, np.uint64))), np.concatenate((first, begin[short]))
    return value, first


class _Items:
    """A block of test items: words and n-grams."""

    def __init__(self, ids: list[int], texts: pa.Array, n: int) -> None:
        self.words: list[np.ndarray] = []
        self.ids: list[int] = []
        grams, owners = [], []
        for chunk in tv.chunks(texts, PLAIN):
            value, first = _grams(chunk, n)
            begin = np.concatenate(([0], np.cumsum(chunk.per_row)))
            for r in range(chunk.rows):
                if chunk.per_row[r]:
                    own = np.unique(value[chunk.row[first] == r])
                    grams.append(own)
                    owners.append(np.full(len(own), len(self.ids)))
                    self.ids.append(ids[chunk.first + r])
                    self.words.append(chunk.hashes[begin[r] : begin[r + 1]])
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)


def _seeds(items: _Items) -> tuple[np.ndarray, np.ndarray]:
    """Sorted seed hashes and the items they belong to."""
    order = np.argsort(items.grams, kind="stable")
    return items.grams[order], items.owners[order]


def _matches(items: _Items, seeds: np.ndarray, owners: np.ndarray, conf: Align):
    """(row, item, score, first word, words) of each item found in a chunk's rows."""
    needs = np.minimum(conf.seeds, np.bincount(owners, minlength=len(items.ids)))
    most = [len(w) * conf.match for w in items.words]

    def run(chunk: tv.Chunk) -> Iterator[tuple[int, int, float, int, int]]:
        value, first = _grams(chunk, conf.n)
        low, high = np.searchsorted(seeds, value, "left"), np.searchsorted(seeds, value, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return
        begin = np.concatenate(([0], np.cumsum(chunk.per_row)))
        times = (high - low)[hit]
        places = np.repeat(first[hit], times)
        found = owners[np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        rows = chunk.row[places]
        order = np.lexsort((places, found, rows))
        rows, found, places = rows[order], found[order], places[order]
        edge = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1]), [True])))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            item, row, at = int(found[i]), int(rows[i]), places[i:j]
            size = len(items.words[item])
            best = (0, 0, 0)
            groups = np.split(at, np.flatnonzero(np.diff(at) > 2 * size) + 1)
            for group in groups:
                if len(group) < needs[item]:
                    continue
                lo = max(int(begin[row]), int(group[0]) - 2 * size)
                hi = min(int(begin[row + 1]), int(group[-1]) + 2 * size + conf.n)
                passage = chunk.hashes[lo:hi]
                # An alignment matches each word of the item once at most.
                if conf.match * np.isin(items.words[item], passage).sum() < conf.threshold * most[item]:
                    continue
                got, end = smith_waterman(items.words[item], passage, conf)
                best = max(best, (got, lo + end - int(begin[row]), hi - lo))
            if best[0] >= conf.threshold * most[item]:
                yield row, item, best[0] / most[item], best[1], size

    return run


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", conf: Align = Align()) -> DataFrame:
    """One row for each document and test item found in it: key, item_id, score, end_word.

    ``end_word`` is where the best alignment ends in the document's words, from 1.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    items = items.select(F.col(item).cast("long").alias("_item"), F.col("text").alias("_text")).where("_item is not null and _text is not null")
    kind = docs.schema["_key"].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item}` long, score double, end_word long"
    blocks = max(1, -(-items.count() // conf.block))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b).orderBy("_item", "_text").toArrow()
        block = _Items(own["_item"].to_pylist(), own["_text"].combine_chunks(), conf.n)
        if not block.ids:
            continue
        seeds, owners = _seeds(block)
        found = docs.mapInArrow(_run(block, seeds, owners, conf, key, item), schema)
        out = found if blocks == 1 else out.unionByName(found)
    return out


def _run(block: _Items, seeds: np.ndarray, owners: np.ndarray, conf: Align, key: str, item: str):
    match = _matches(block, seeds, owners, conf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, scores, ends = [], [], [], []
            for chunk in tv.chunks(batch.column(1), PLAIN):
                for row, at, score, end, _ in match(chunk):
                    rows.append(chunk.first + row)
                    ids.append(block.ids[at])
                    scores.append(score)
                    ends.append(end)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(ends, pa.int64())],
                names=[key, item, "score", "end_word"],
            )

    return run
