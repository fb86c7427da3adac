"""Words, word hashes and n-gram hashes of whole Arrow string columns, in numpy.

The data buffer of an Arrow string column is one run of UTF-8 bytes, so the words of
thousands of documents are found and hashed by a few vector operations and no Python
object is made per word.  Work goes in chunks of rows of about ``CHUNK`` bytes, so that
memory is bounded by the chunk or by the longest single text, whichever is larger.

Nulls are read as empty texts; empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U64 = np.uint64

#: Bytes that separate words: space, and tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes with A-Z lower-cased, and bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SAME = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), CHUNK + 1)
            up, down = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 1 << 64), U64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit depends on every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Chunk:
    """Some rows of a column: bytes, row bounds, and the words with their rows and hashes."""

    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    per_row: np.ndarray
    hashes: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array, table: np.ndarray = LOWER) -> Iterator[Chunk]:
    """The column in chunks of rows, each with its words; ``table`` maps bytes first."""
    data, bounds = buffers(column)
    n, at = len(bounds) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
        yield _chunk(at, table[data[bounds[at] : bounds[to]]], bounds[at : to + 1] - bounds[at])
        at = to


def _chunk(first: int, data: np.ndarray, bounds: np.ndarray) -> Chunk:
    word = np.zeros(len(data) + 1, dtype=bool)
    word[:-1] = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | edge))
    ends = np.flatnonzero(before & (~word | edge))
    row = np.searchsorted(bounds, starts, "right") - 1
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Chunk(first, data, bounds, starts, ends, row, np.bincount(row, minlength=len(bounds) - 1), hashes)


def word_hash(word: str) -> int:
    """The hash that ``chunks`` gives to this word."""
    (chunk,) = chunks(pa.array([word]), SAME)
    return int(chunk.hashes[0])


def ngrams(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of k words inside one row."""
    n = len(chunk.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    # Odd factors without a small relation between them, so that no two orders of a few
    # words sum to the same.
    factors = mix(np.arange(1, k + 1, dtype=U64) * U64(_BASE)) | U64(1)
    total = np.zeros(n, U64)
    for j in range(k):
        total += chunk.hashes[j : j + n] * factors[j]
    inside = np.flatnonzero(chunk.row[:n] == chunk.row[k - 1 :])
    return mix(total[inside]), inside


def shingle_sets(chunk: Chunk, k: int) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word shingles.

    A row with fewer words than k, but some, has one shingle: its whole word sequence.
    """
    hashes, first = ngrams(chunk, k)
    counts = np.bincount(chunk.row[first], minlength=chunk.rows) if len(first) else np.zeros(chunk.rows, np.int64)
    at = np.concatenate(([0], np.cumsum(counts)))
    words = np.concatenate(([0], np.cumsum(chunk.per_row)))
    out = []
    for r in range(chunk.rows):
        if counts[r]:
            s = np.sort(hashes[at[r] : at[r + 1]])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif chunk.per_row[r]:
            total = len(chunk.hashes[words[r] : words[r + 1]])
            for h in chunk.hashes[words[r] : words[r + 1]].tolist():
                total = (total * 0xD6E8FEB86659FD93 + h) & _MASK
            out.append(mix(np.array([total], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out
