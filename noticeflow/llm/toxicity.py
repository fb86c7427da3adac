"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word is its whole form and its character n-grams between word marks, each hashed to a
row of one embedding table; a text is the mean of the rows of all its words, and a linear
softmax over two classes reads it.  A misspelling that was never seen shares most n-grams
with its source, and so its score.

The first column of the table begins as the log odds of a bucket's share in the two labels,
and 0 where the shares do not differ by ``least_z`` standard errors, so that the many rare
buckets of a small table start without an opinion.  Then table and softmax are trained
together.  How long is chosen on a part of the training rows that a first model did not
see, and the model is trained anew on all of them; no other row takes part.

Training takes a bounded sample of labelled rows (``rows`` by hash of the id, of which as
many as have ``chars`` characters together, and one at least); scoring covers every whole
text.  As the softmax is linear in a mean, each embedding row counts for one number at
scoring time, and a text's logit is the mean of those numbers plus the bias.

Null and empty texts have no words and get the score of the bias alone.  Rows are kept one
for one, repeated or not; an empty table gives an empty result.  Labels or ids that are null
are not learnt from; an id with several labels counts as the highest, and one with several
texts as the first of them in code-point order.  Without labelled rows of both classes every
score is the share of label 1, or 0.  Columns named like the result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import textvec as tv

SIZES = (3, 4, 5)


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and hyper-parameters."""

    rows: int = 10_000
    chars: int = 60_000_000
    buckets: int = 1 << 17
    dims: int = 4
    epochs: int = 60
    rate: float = 0.03
    folds: int = 4
    least_z: float = 5.0
    smooth: float = 0.02
    min_texts: int = 3
    threshold: float = 0.3


@dataclass
class Model:
    """A number for each bucket, and the bias."""

    weights: np.ndarray
    bias: float


def _codes(chunk: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points with 0 for white space and around each row, and the rows' places in them."""
    # Bytes that are no UTF-8 stay apart, one code each, so that places keep their meaning.
    text = np.frombuffer(chunk.data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((chunk.data & 0xC0) != 0x80)))
    if heads[-1] != len(text):
        text = chunk.data.astype(np.uint32)
        heads = np.arange(len(text) + 1)
    bounds = heads[chunk.bounds]
    blank = (text == 0x20) | ((text >= 0x09) & (text <= 0x0D))
    marked = np.where(blank, 0, text)
    out = np.insert(marked, bounds, 0).astype(np.uint64)
    return out, bounds + np.arange(len(bounds))


def features(chunk: tv.Chunk, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of each subword: whole words, then the n-grams of each size."""
    yield chunk.row, (chunk.hashes % np.uint64(buckets)).astype(np.int64)
    codes, rows = _codes(chunk)
    n = len(codes)
    inside = np.cumsum(codes == 0)
    for size in SIZES:
        if n < size:
            continue
        total = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            total = total * np.uint64(0x100000001B3) + codes[j : j + n - size + 1]
        # No mark between the first and the last of the window.
        clear = np.flatnonzero(inside[size - 2 : n - 1] == inside[: n - size + 1])
        value = tv.mix(total[clear] + np.uint64(size << 56))
        yield np.searchsorted(rows, clear, "right") - 1, (value % np.uint64(buckets)).astype(np.int64)


def train(texts: pa.Array, labels: np.ndarray, t: Training = Training()) -> Model:
    """Log odds, then full-batch descent over the embedding table, the softmax and the bias."""
    n, y = len(labels), labels.astype(np.float64)
    if not n or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if n else 1e-6
        return Model(np.zeros(t.buckets, np.float32), float(np.log(share / (1 - share))))
    doc, word, times, known = [], [], [], {}
    for chunk in tv.chunks(texts):
        order = np.lexsort((chunk.hashes, chunk.row))
        r, h = chunk.row[order], chunk.hashes[order]
        at = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])))) if len(r) else np.zeros(0, np.int64)
        doc.append((r[at] + chunk.first).astype(np.int32))
        word.append(h[at])
        times.append(np.diff(np.concatenate((at, [len(r)]))).astype(np.float32))
        for value, i in zip(h[at].tolist(), order[at].tolist(), strict=True):
            if value not in known:
                known[value] = chunk.data[chunk.starts[i] : chunk.ends[i]].tobytes()
    doc, word, times = map(np.concatenate, (doc, word, times))
    vocabulary, place, spread = np.unique(word, return_inverse=True, return_counts=True)
    kept = np.flatnonzero(spread >= min(t.min_texts, max(1, n // 10)))
    strings = pa.array([known[v].decode("utf-8", "replace") for v in vocabulary[kept].tolist()], pa.string())
    del known
    index = np.full(len(vocabulary), -1, np.int32)
    index[kept] = np.arange(len(kept))
    of = index[place]
    doc, of, times = doc[of >= 0], of[of >= 0], times[of >= 0]
    owner, bucket = [], []
    for chunk in tv.chunks(strings, tv.SAME):
        for r, b in features(chunk, t.buckets):
            owner.append((r + chunk.first).astype(np.int32))
            bucket.append(b.astype(np.int32))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    width = np.bincount(owner, minlength=len(kept))
    size = np.bincount(doc, weights=times * width[of], minlength=n)
    share = (times / np.maximum(size, 1)[doc]).astype(np.float32)

    bag = _Bag(doc, of, share, owner, bucket, y, len(kept), t)
    unseen = np.arange(n) % t.folds == t.folds - 1
    _, losses = bag.descend(~unseen, t.epochs, unseen)
    weights, bias = bag.descend(np.ones(n, bool), int(np.argmin(losses)) if losses else 0, None)[0]
    return Model(weights.astype(np.float32), bias)


@dataclass
class _Bag:
    """Training texts as shares of words (doc, of, share), and words as buckets (owner, bucket)."""

    doc: np.ndarray
    of: np.ndarray
    share: np.ndarray
    owner: np.ndarray
    bucket: np.ndarray
    y: np.ndarray
    words: int
    t: Training

    def means(self, column: np.ndarray) -> np.ndarray:
        """Mean of a column of the table in each text."""
        sums = np.bincount(self.owner, weights=column[self.bucket], minlength=self.words)
        return np.bincount(self.doc, weights=self.share * sums[self.of], minlength=len(self.y))

    def odds(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of each bucket's mean share in the labels, where they differ for sure."""
        size, t = self.t.buckets, self.t
        order = np.argsort(self.owner, kind="stable")
        buckets, at = self.bucket[order], np.searchsorted(self.owner[order], np.arange(self.words + 1))
        sums = np.zeros((2, 2, size))
        count = at[self.of + 1] - at[self.of]
        # Blocks of whole texts, so that the pairs of a text and a bucket stay few at a time.
        ends = np.flatnonzero(np.concatenate((self.doc[1:] != self.doc[:-1], [True]))) + 1 if len(self.doc) else np.zeros(0, np.int64)
        total, low = np.cumsum(count), 0
        for high in ends.tolist():
            if high < len(self.doc) and total[high - 1] - (total[low - 1] if low else 0) < 1_000_000:
                continue
            part = np.arange(low, high)[rows[self.doc[low:high]]]
            low, n = high, count[part]
            if not n.sum():
                continue
            places = np.repeat(at[self.of[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key, back = np.unique(np.repeat(self.doc[part], n).astype(np.int64) * size + buckets[places], return_inverse=True)
            value = np.bincount(back, weights=np.repeat(self.share[part], n))
            for label in (0, 1):
                own = self.y[key // size] == label
                for k in (0, 1):
                    sums[label, k] += np.bincount(key[own] % size, weights=value[own] ** (k + 1), minlength=size)
        n1 = self.y[rows].sum()
        n0 = rows.sum() - n1
        if not n0 or not n1:
            return np.zeros(size)
        m0, m1 = sums[0, 0] / n0, sums[1, 0] / n1
        spread = (sums[0, 1] + sums[1, 1] - n0 * m0**2 - n1 * m1**2) / (n0 + n1)
        z = (m1 - m0) / np.sqrt(np.maximum(spread * (1 / n0 + 1 / n1), 1e-18))
        least = t.smooth * (m0 + m1) + 1e-12
        return np.where(np.abs(z) > t.least_z, np.log((m1 + least) / (m0 + least)), 0.0)

    def descend(self, rows: np.ndarray, epochs: int, unseen: np.ndarray | None):
        """((weight of each bucket, bias), losses on ``unseen`` after 0, 1, ... epochs)."""
        t, n, y = self.t, len(self.y), self.y
        rng = np.random.default_rng(7)
        table = rng.normal(0, 0.01, (t.dims, t.buckets))
        table[0] = self.odds(rows)
        w = rows / rows.sum()
        means = np.stack([self.means(c) for c in table])
        mid = float((means[0] * w).sum())
        unit = float(np.sqrt(((means[0] - mid) ** 2 * w).sum())) + 1e-12
        line, x = np.zeros(2), np.stack(((means[0] - mid) / unit, np.ones(n)))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(line @ x, -30, 30)))
            slope = x @ ((p - y) * w) + 1e-3 * line * (1, 0)
            line = line - np.linalg.solve((x * (p * (1 - p) * w)) @ x.T + np.diag((1e-3, 1e-6)), slope)
        soft = rng.normal(0, 0.01, t.dims) * abs(line[0]) / unit
        soft[0], bias = line[0] / unit, line[1] - line[0] * mid / unit
        reach, losses, state = abs(soft[0]) * 0.02, [], [0.0, 0.0, 0.0, 0.0]
        for epoch in range(1, epochs + 2):
            if epoch > 1:
                means = np.stack([self.means(c) for c in table])
            p = 1 / (1 + np.exp(-np.clip(soft @ means + bias, -30, 30)))
            if unseen is not None and unseen.any():
                q, own = np.clip(p[unseen], 1e-9, 1 - 1e-9), y[unseen]
                losses.append(float(-(own * np.log(q) + (1 - own) * np.log(1 - q)).mean()))
            if epoch > epochs:
                break
            g = (p - y) * w
            per_word = np.bincount(self.of, weights=self.share * g[self.doc], minlength=self.words)
            per_bucket = np.bincount(self.bucket, weights=per_word[self.owner], minlength=t.buckets)
            slope, top = soft[:, None] * per_bucket, np.append(means @ g, g.sum())
            state[0] = 0.9 * state[0] + 0.1 * slope
            # Mostly one step size for all buckets: rare ones move little, so they overfit little.
            state[1] = 0.99 * state[1] + 0.01 * (0.1 * slope**2 + 0.9 * (slope**2).max())
            state[2] = 0.9 * state[2] + 0.1 * top
            state[3] = 0.99 * state[3] + 0.01 * top**2
            step = lambda a, b, e=epoch: t.rate * (a / (1 - 0.9**e)) / (np.sqrt(b / (1 - 0.99**e)) + 1e-12)
            table = table - step(state[0], state[1])
            move = 0.2 * step(state[2], state[3])
            soft, bias = soft - reach * move[:-1], bias - move[-1]
        return (soft @ table, float(bias)), losses


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """The probability of label 1 for each text."""
    out = []
    for chunk in tv.chunks(texts):
        total, size = np.zeros(chunk.rows), np.zeros(chunk.rows)
        for r, b in features(chunk, len(model.weights)):
            total += np.bincount(r, weights=model.weights[b], minlength=chunk.rows)
            size += np.bincount(r, minlength=chunk.rows)
        out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(size, 1) + model.bias, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> Model:
    """Trains on at most ``t.rows`` labelled rows (doc_id, toxic), those of least hash, and
    ``t.chars`` characters of them."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(t.rows)
    )
    # Bounded by the sample's size, so it may be broadcast, and ids and lengths gathered.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sizes = texts.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    taken, left = [], t.chars
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        left -= r.n
        if left < 0 and taken:
            break
        taken.append(r.doc_id)
    if not taken:
        return train(pa.array([], pa.string()), np.zeros(0, np.int64), t)
    own = docs.sparkSession.createDataFrame([(i,) for i in taken], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    table = texts.join(F.broadcast(own), "doc_id").select("text", "toxic").toArrow()
    order = np.argsort(np.array(table["text"].fill_null("").to_pylist(), object), kind="stable")
    table = table.take(pa.array(np.random.default_rng(3).permutation(order), pa.int64()))
    return train(table["text"].combine_chunks(), table["toxic"].to_numpy(), t)


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` without its text, with ``column``: every whole text's score."""
    kept = [c for c in docs.columns if c not in (text, column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.record_batch([*columns, pa.array(scores(batch.column(len(kept)), model))], names=[*kept, column])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept, text).mapInArrow(run, ", ".join(x for x in (fields, f"`{column}` double") if x))
