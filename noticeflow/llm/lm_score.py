"""Language-model scoring: cross-entropy difference of a target and a background model.

Both are bigram models of words with Dirichlet smoothing towards their unigrams, over one
shared vocabulary: every word of the corpus, and one start mark.  The background counts come
from every document, the target counts from every document that the caller marks.  A
document's score is the mean over its tokens of target loss less background loss (nats): the
lower, the more it resembles the target.

Documents are dealt to blocks of bounded size by key.  A block counts its own words and
pairs, as sorted 64-bit hashes, and sends each range of hashes to one part; a part adds up
its range over all blocks and answers each block in the order in which the block asked.  So
all counts are kept, no task holds more than a block or a part, and the model is never in
one place.  Words, pairs and marked keys are the same if their hashes are.

Null and empty texts have no tokens and score 0.  Rows are kept one for one.  Without any
target document the target model is uniform over the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm import textvec as tv

#: In the place of a word's hash: words outside a limited vocabulary, and the start of a text.
UNKNOWN, START = (tv.mix(np.array([x], np.uint64))[0] for x in (11, 12))

#: Kinds of counts, in the low bits of a key: words, pairs, and words that end a text (or START).
WORD, PAIR, LAST = (np.uint64(x) for x in range(3))

_SENT = "part int, block int, size int, keys binary, n binary, m binary"
_ANSWER = "block int, part int, n binary, m binary, end_n binary, end_m binary, words long, total_n long, total_m long"


@dataclass(frozen=True)
class Conf:
    """Most frequent words kept (None: all), weight of the unigrams in a context, bytes of text in a block."""

    words: int | None = None
    prior: float = 50.0
    block: int = 4_000_000


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0

    def flush():
        value, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        return pa.record_batch([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    for batch in batches:
        for chunk in tv.chunks(batch.column(0)):
            held.append(chunk.hashes)
            total += len(chunk.hashes)
            if total > 2_000_000:
                yield flush()
                held, total = [], 0
    yield flush()


def _key(hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
    return (hashes << np.uint64(2)) | kind


@dataclass
class _Tokens:
    """The tokens of a block: rows, and keys of words, of contexts' ends and of pairs."""

    row: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    last: np.ndarray
    last_row: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return np.concatenate((self.word, self.pair, self.last))

    @property
    def rows(self) -> np.ndarray:
        return np.concatenate((self.row, self.row, self.last_row))


def _tokens(texts: pa.Array, vocabulary: np.ndarray | None) -> _Tokens:
    found = [(chunk.hashes, chunk.first + chunk.row) for chunk in tv.chunks(texts)]
    hashes = np.concatenate([h for h, _ in found] or [np.zeros(0, np.uint64)])
    row = np.concatenate([r for _, r in found] or [np.zeros(0, np.int64)])
    if vocabulary is not None and len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        hashes = np.where(vocabulary[at] == hashes, hashes, UNKNOWN)
    before = np.concatenate(([START], hashes[:-1]))[: len(hashes)]
    edge = np.flatnonzero(row[1:] != row[:-1])
    before[edge + 1] = START
    ends = np.concatenate((edge, [len(row) - 1])) if len(row) else edge
    pair = tv.mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes * np.uint64(0xD6E8FEB86659FD93))
    last = np.concatenate((_key(hashes[ends], LAST), np.full(len(ends), _key(START, LAST))))
    return _Tokens(row, _key(hashes, WORD), before, _key(pair, PAIR), last, np.concatenate((row[ends], row[ends])))


def _pack(values: np.ndarray) -> bytes:
    """64-bit values by planes of bytes, compressed: small values leave most planes empty."""
    planes = np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int) -> np.ndarray:
    if not size:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, 8 * size, codec="zstd"), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from one to the next."""
    return _pack(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def _unpack_keys(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpack(data, size).view(np.uint64), dtype=np.uint64)


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted keys, and the end."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def _table(columns: dict[str, list], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.table({name: pa.array(columns[name], kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))})


def _counted(vocabulary: np.ndarray | None, parts: int):
    """A block's own counts, a row for each part."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        out = {name: [] for name in ("part", "block", "size", "keys", "n", "m")}
        tokens = _tokens(docs["_text"], vocabulary)
        target = np.isin(docs["_id"].to_numpy(), marks["mark"].to_numpy())
        keys = tokens.keys
        own, n = np.unique(keys, return_counts=True)
        marked, times = np.unique(keys[target[tokens.rows]], return_counts=True)
        m = np.zeros(len(own), np.int64)
        m[np.searchsorted(own, marked)] = times
        edge = _parts(own, parts)
        for p in np.flatnonzero(np.diff(edge)).tolist():
            i, j = edge[p], edge[p + 1]
            for name, value in zip(out, (p, docs["_block"][0].as_py(), int(j - i), _pack_keys(own[i:j]), _pack(n[i:j]), _pack(m[i:j])), strict=True):
                out[name].append(value)
        return _table(out, _SENT)

    return run


def _added(blocks: int):
    """A part's counts over all blocks, an answer for each block, with the part's share of the totals."""

    def run(sent: pa.Table) -> pa.Table:
        sizes = sent["size"].to_pylist()
        asked = [_unpack_keys(x, s) for x, s in zip(sent["keys"].to_pylist(), sizes, strict=True)]
        own, at = np.unique(np.concatenate(asked), return_inverse=True)
        n, m = (np.bincount(at, np.concatenate([_unpack(x, s) for x, s in zip(sent[c].to_pylist(), sizes, strict=True)]), len(own)).astype(np.int64) for c in ("n", "m"))
        word = (own & np.uint64(3)) == WORD
        # A word and its ends have the same hash, so they meet in one part, whichever block has seen which.
        last = np.minimum(np.searchsorted(own, own | LAST), len(own) - 1)
        ends = word & (own[last] == (own | LAST))
        end_n, end_m = np.where(ends, n[last], 0), np.where(ends, m[last], 0)
        totals = int((own[word] != _key(UNKNOWN, WORD)).sum()), int(n[word].sum()), int(m[word].sum())
        answers = dict.fromkeys(range(blocks), (b"",) * 4)
        for block, where in zip(sent["block"].to_pylist(), np.split(at, np.cumsum(sizes)[:-1]), strict=True):
            answers[block] = tuple(_pack(c[where]) for c in (n, m, end_n, end_m))
        part, names = sent["part"][0].as_py(), [x.split()[0] for x in _ANSWER.split(", ")]
        rows = [(block, part, *answer, *totals) for block, answer in answers.items()]
        return _table(dict(zip(names, zip(*rows, strict=True), strict=True)), _ANSWER)

    return run


def _scored(vocabulary: np.ndarray | None, parts: int, prior: float, key: str):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = _tokens(docs["_text"], vocabulary)
        own = np.unique(tokens.keys)
        size = np.diff(_parts(own, parts))
        edge = np.concatenate(([0], np.cumsum(size)))
        n, m, end_n, end_m = (np.zeros(len(own), np.int64) for _ in range(4))
        for column, counts in (("n", n), ("m", m), ("end_n", end_n), ("end_m", end_m)):
            for part, data in zip(answers["part"].to_pylist(), answers[column].to_pylist(), strict=True):
                counts[edge[part] : edge[part + 1]] = _unpack(data, size[part])
        words, total_n, total_m = (int(answers[c].to_numpy().sum()) for c in ("words", "total_n", "total_m"))

        word, pair = np.searchsorted(own, tokens.word), np.searchsorted(own, tokens.pair)
        first = np.searchsorted(own, _key(START, LAST))
        start = tokens.before == START
        before = np.concatenate((word[:1], word[:-1]))

        def loss(counts: np.ndarray, ends: np.ndarray, total: int) -> np.ndarray:
            # A word is a context wherever it does not end a text.
            context = np.where(start, counts[first], (counts - ends)[before])
            unigram = (counts[word] + 1.0) / (total + words + 1.0)
            return np.log((context + prior) / (counts[pair] + prior * unigram))

        gains = loss(m, end_m, total_m) - loss(n, end_n, total_n) if len(own) else np.zeros(0)
        n_tokens = np.bincount(tokens.row, minlength=docs.num_rows)
        total = np.bincount(tokens.row, weights=gains, minlength=docs.num_rows)
        return pa.table([docs["_key"], pa.array(n_tokens.astype(np.int64)), pa.array(total / np.maximum(n_tokens, 1))], names=[key, "n_tokens", "score"])

    return run


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", conf: Conf = Conf()) -> DataFrame:
    """One row per row of ``docs``: key, n_tokens and score; ``target`` has the marked keys."""
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = docs.schema["_key"].dataType.simpleString()
    vocabulary = None
    if conf.words is not None:
        words = docs.select("_text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        top = words.orderBy(F.desc("n"), "word").limit(conf.words).select("word")
        vocabulary = np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))

    blocks = 1 + (docs.agg(F.sum(F.octet_length("_text"))).head()[0] or 0) // conf.block
    parts = -(-blocks // 2)

    def block(by) -> F.Column:
        return F.pmod(by, F.lit(blocks)).cast("int")

    # Rows without a key are never marked; their texts deal them out.
    ids = F.when(F.col("_key").isNotNull(), F.xxhash64("_key"))
    docs = docs.select("_key", "_text", ids.alias("_id"), block(F.coalesce(ids, F.xxhash64("_text"))).alias("_block"))
    marks = target.select(F.col(key).cast(kind).alias("_key")).where("_key is not null").distinct().select(F.xxhash64("_key").alias("mark"))
    marks = marks.select(block(F.col("mark")).alias("block"), "mark")
    sent = docs.groupBy("_block").cogroup(marks.groupBy("block")).applyInArrow(_counted(vocabulary, parts), _SENT)
    answers = sent.groupBy("part").applyInArrow(_added(blocks), _ANSWER)
    return docs.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(_scored(vocabulary, parts, conf.prior, key), f"`{key}` {kind}, n_tokens long, score double")
