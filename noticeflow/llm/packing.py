"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become token ids and an end id.  Only documents longer than a sequence are cut,
into pieces of full length of which the first may be shorter; full pieces are sequences of
their own.  All other pieces are dealt at random to blocks of bounded size, and each block
is packed by several islands.  An individual is a set of bins.  Crossover injects some
well-filled bins of one parent into the other, drops the bins that hold the same pieces
again, and best-fits the pieces so displaced, longest first; mutation opens the emptiest
bins and some others and fills bins anew by subset sums.  Islands evolve alone for some
generations, then each sends its best individual to the next one; every round is a Spark
step over one row per island, written to the shared folder.  The emptiest bin of each block
is opened in the end and packed with those of the other blocks, level by level, until one
block is left, so blocks cost about one sequence in all, not one each.

Null and empty texts are the end id alone.  Repeated rows are packed as often as they are
there; null ids are kept.  A very long text is held once, with its ids, by one task.  An
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.storage import drop, written

END = b"\0\0\0\0"
#: Letters and marks between which, and around line ends, pieces are cut for sure.
_LETTERS, _POINTS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?$%&*#|<>"
_AFTER = frozenset(_POINTS + "\n")
#: Bytes of text that are taken at a time, and parts whose ids are gathered at a time.
_TEXT, _GATHER = 16_000_000, 500_000
#: Parts of letters, marks and lines, and where their pieces end.
_KNOWN = rf"\A[{_LETTERS}]{{1,64}}[{_POINTS}]*(?:\n[{_LETTERS}]{{1,64}}[{_POINTS}]*)*\z"
_PIECE = rf"(\n|[{_POINTS}]+)"
#: A space before white space or the end, where texts are not simply cut.
_ODD = r" (?:[\x{1}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"


@dataclass(frozen=True)
class Conf:
    """Sequence length, pieces in a block, and the sizes of the search."""

    length: int = 2048
    block: int = 4096
    islands: int = 4
    population: int = 6
    rounds: int = 4
    generations: int = 25
    cache: int = 250_000


class Encoder(dict):
    """Token ids, as bytes of little-endian 32-bit numbers, of a text, by ``tokenizers``.

    Byte-level splitting never joins what stands before a space with what follows it, if
    that is not white space itself; nor do special tokens without spaces.  So texts are cut
    there, and the ids of each short part (which starts with its space) are kept in a
    bounded cache: this object, from part to ids, and the one before it, from which parts
    that are met again come back.  Letters, marks after them and line ends are pieces of their
    own, so of a column only distinct words are looked up, in arrays of as many words; all
    grow by the words of ``_TEXT`` bytes at most.  A tokenizer file for which this does not
    hold is run over whole texts.
    """

    def __init__(self, path: str, size: int = 250_000) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            table = json.load(f)
        split = table.get("pre_tokenizer") or {}
        plain = [not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in table.get("added_tokens", ())]
        self._whole = table.get("normalizer") is not None or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or not all(plain)
        tokenizer = Tokenizer.from_file(path)
        self._encode = tokenizer.encode
        # Bytes of text that a token stands for; a byte-level vocabulary has a letter a byte.
        self._width = np.zeros(max(tokenizer.get_vocab().values(), default=0) + 1, np.int64)
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            self._width[i] = len(token)
        for t in table.get("added_tokens", ()):
            self._width[t["id"]] = len(t["content"].encode())
        self._cut = re.compile(r" (?=\S)").split
        self._word = re.compile(rf"([{_LETTERS}]{{1,64}})([{_POINTS}]*)((?:\n[{_LETTERS}]{{1,64}}[{_POINTS}]*)*)").fullmatch
        self._letters = re.compile(f"[{_LETTERS}]{{1,64}}").match
        self._size, self._before, self._pieces = size, {}, {}
        # Words of columns, with a space before them: ids in a row, begin and count of each.
        self._words, self._met = pa.array([], pa.string()), np.zeros(0, bool)
        self._ids, self._start, self._count = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, text: str) -> bytes:
        return np.array(self._encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _rest(self, points: str, tail: str) -> bytes:
        """Punctuation, and lines of a word and punctuation each, after a word."""
        out = self._piece(points) if points else b""
        for line in tail.split("\n")[1:]:
            word = line.rstrip(_POINTS)
            out += self._piece("\n") + self._piece(word)
            if len(word) < len(line):
                out += self._piece(line[len(word) :])
        return out

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that has no space before it."""
        out = self._pieces.get(piece)
        if out is None:
            if len(self._pieces) >= self._size:
                self._pieces.clear()
            out = self._pieces[piece] = self.ids(piece)
        return out

    def head(self, part: str) -> bytes:
        """Ids of the first part of a text."""
        if found := self._word(part):
            return self._piece(found[1]) + self._rest(found[2], found[3])
        return self.ids(part) if part else b""

    def __missing__(self, part: str) -> bytes:
        out = self._before.get(part)
        if out is None:
            found = self._word(part)
            out = self[found[1]] + self._rest(found[2], found[3]) if found and (found[2] or found[3]) else self.ids(" " + part)
        if len(part) <= 64:
            self[part] = out
        return out

    def _turn(self) -> None:
        """Between texts: a full cache becomes the one before."""
        if len(self) >= self._size:
            self._before = dict(self)
            self.clear()

    def _together(self, words: list[str], gap: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters in a row, and how many each has, by runs over many of them.

        Each is a piece of its own, with a space before it, or, if lines part them, without.
        """
        out, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 512):
            own = words[at : at + 512]
            ids = np.array(self._encode(gap + gap.join(own), add_special_tokens=False).ids, "<u4")
            reach = np.cumsum(self._width[ids])
            goal = np.cumsum([len(w.encode()) + 1 for w in own])
            ends = np.searchsorted(reach, goal) + 1
            begins = np.concatenate(([0], ends[:-1]))
            size = ends - begins
            fits = len(reach) == ends[-1] and (reach[ends - 1] == goal).all()
            if fits and gap != " ":
                fits = (self._width[ids[begins]] == 1).all()
                ids, size = np.delete(ids, begins), size - 1
            if not fits:
                each = [self.ids(gap.replace("\n", "") + w) for w in own]
                ids, size = np.frombuffer(b"".join(each), "<u4"), np.array([len(e) // 4 for e in each])
            out.append(ids)
            sizes.append(size)
        return np.concatenate(out), np.concatenate(sizes)

    def learn(self, words: list[str], gap: str = " ") -> None:
        """Caches words of letters."""
        ids, size = self._together(words, gap)
        data, ends = ids.tobytes(), np.cumsum(size).tolist()
        (self if gap == " " else self._pieces).update((w, data[4 * i : 4 * j]) for w, i, j in zip(words, [0, *ends], ends, strict=False))

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all known words, and where those of these distinct words begin and how many."""
        if len(self._words) >= 2 * self._size:
            # Those met since this was done last stay.
            kept = np.flatnonzero(self._met)
            self._ids = self._ids[_runs(self._start[kept], self._count[kept])]
            self._words, self._count = self._words.take(pa.array(kept)), self._count[kept]
            self._start, self._met = np.cumsum(self._count) - self._count, np.zeros(len(kept), bool)
        words = words.cast(self._words.type)
        place = pc.index_in(words, value_set=self._words)
        fresh = words.filter(place.is_null())
        ids, count = self._together(fresh.to_pylist(), " ")
        at, new = place.fill_null(-1).to_numpy().astype(np.int64), len(self._words)
        at[at < 0] = new + np.arange(len(fresh))
        self._start = np.concatenate((self._start, len(self._ids) + np.cumsum(count) - count))
        self._ids, self._count = np.concatenate((self._ids, ids)), np.concatenate((self._count, count))
        self._words = pa.concat_arrays([self._words, fresh])
        self._met = np.concatenate((self._met, np.zeros(len(fresh), bool)))
        self._met[at] = True
        return self._ids, self._start[at], self._count[at]

    def columns(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column without nulls, some megabytes of text at a time."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _TEXT, "right")))
            part = texts.slice(at, to - at)
            odd = pa.array(np.ones(len(part), bool)) if self._whole else pc.match_substring_regex(part, _ODD)
            plain = self._plain(part.filter(pc.invert(odd))) if pc.any(pc.invert(odd)).as_py() else iter(())
            for i, whole in enumerate(odd.to_pylist()):
                yield np.frombuffer(self.document(part[i].as_py()), "<u4") if whole else next(plain)
            at = to

    def _plain(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Texts that can be cut at each space: ids of distinct parts are gathered."""
        self._turn()
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = cut.flatten().dictionary_encode()
        # The first part of a text has no space before it.
        heads, spaced = bounds[:-1], len(coded.dictionary)
        codes = coded.indices.to_numpy().astype(np.int64)
        data, size = self._parts(pa.concat_arrays([coded.dictionary, coded.dictionary.take(coded.indices.take(pa.array(heads)))]), spaced)
        codes[heads] = spaced + np.arange(len(heads))
        start, at = np.cumsum(size) - size, 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _GATHER, "right")) - 1)
            own = codes[bounds[at] : bounds[to]]
            count = size[own]
            ids = data[_runs(start[own], count)]
            edge = np.concatenate(([0], np.cumsum(count)))[bounds[at : to + 1] - bounds[at]].tolist()
            yield from (ids[i:j] for i, j in itertools.pairwise(edge))
            at = to

    def _parts(self, parts: pa.Array, spaced: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these parts in a row, and how many each has; the first ``spaced`` have a
        space before them."""
        known = pc.match_substring_regex(parts, _KNOWN)
        own = known.to_numpy(zero_copy_only=False)
        others = np.flatnonzero(~own)
        cut = pc.split_pattern(pc.replace_substring_regex(parts.filter(known), _PIECE, "\x01\\1\x01"), "\x01")
        pieces, begins = cut.flatten(), cut.offsets.to_numpy()[:-1].astype(np.int64)
        there = pc.binary_length(pieces).to_numpy() > 0
        word = np.zeros(len(pieces), bool)
        word[begins[np.flatnonzero(own) < spaced]] = True
        words, bare = (pieces.filter(pa.array(x)).dictionary_encode() for x in (word, there & ~word))
        others_ = [(i < spaced, parts[i].as_py()) for i in others.tolist()]
        found = self._bare(bare.dictionary.to_pylist()) + [self[p] if after else self.head(p) for after, p in others_]
        known_ids, begin, size = self._spaced(words.dictionary)

        # Each part is a run of units: its pieces, or itself.
        unit = np.empty(len(pieces), np.int64)
        unit[word] = words.indices.to_numpy()
        unit[there & ~word] = len(size) + bare.indices.to_numpy()
        count = np.ones(len(parts), np.int64)
        count[own] = np.add.reduceat(there, begins, dtype=np.int64) if len(begins) else 0
        first = np.cumsum(count) - count
        units = np.empty(int(count.sum()), np.int64)
        units[first[others]] = len(size) + len(found) - len(others) + np.arange(len(others))
        units[_runs(first[own], count[own])] = unit[there]
        more = np.array([len(f) for f in found], np.int64) // 4
        begin, size = np.concatenate((begin, len(known_ids) + np.cumsum(more) - more)), np.concatenate((size, more))
        ids = np.concatenate((known_ids, np.frombuffer(b"".join(found), "<u4")))[_runs(begin[units], size[units])]
        return ids, np.add.reduceat(size[units], first) if len(first) else first

    def _bare(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that have no space before them."""
        if len(self._pieces) >= self._size:
            self._pieces.clear()
        self.learn([p for p in pieces if p not in self._pieces and self._letters(p)], "\n")
        self._pieces.update((p, self.ids(p)) for p in pieces if p not in self._pieces)
        return [self._pieces[p] for p in pieces]

    def _meet(self, parts: list[str]) -> None:
        """Runs over the new words among these parts together."""
        known, letters, fresh = self._before, self._letters, set()
        for p in parts:
            if p not in self and p not in known and (m := letters(p)) and (w := m[0]) not in self and w not in known:
                rest = p[len(w) : len(w) + 1]
                if not rest or rest in _AFTER:
                    fresh.add(w)
        self.learn(sorted(fresh))

    def document(self, text: str) -> bytes:
        if self._whole:
            return self.ids(text)
        self._turn()
        first, *parts = self._cut(text)
        self._meet(list(set(parts)))
        return self.head(first) + b"".join([self[p] for p in parts])


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as it counts."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, size: int) -> Encoder:
    """One for all tasks that a worker runs."""
    return Encoder(path, size)


def _pieces(path: str, conf: Conf):
    """(doc_id, piece, start, length, ids_crc32, uid) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, conf.cache)
        uid = TaskContext.get().partitionId() << 34
        for batch in batches:
            docs, piece, start, length, crc = [], [], [], [], []
            ids = batch.column(0)
            texts = batch.column(1).fill_null("")
            for i, body in enumerate(encoder.columns(texts)):
                total = len(body) + 1
                cut = total % conf.length or min(total, conf.length)
                at, k = 0, 0
                while at < total:
                    docs.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(cut)
                    sum_ = zlib.crc32(body[at : at + cut])
                    crc.append(zlib.crc32(END, sum_) if at + cut == total else sum_)
                    at, k, cut = at + cut, k + 1, conf.length
            yield pa.record_batch(
                [
                    ids.take(pa.array(docs, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.arange(uid, uid + len(docs))),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"],
            )
            uid += len(docs)

    return run


def best_fit(order, sizes: list[int], bins: np.ndarray, room: list[int], capacity: int) -> np.ndarray:
    """Puts the items into the fullest bin that takes them, in this order; else in a new one.

    ``bins`` (item to bin) is changed; ``room`` has what each bin there is can still take.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for b, r in enumerate(room):
        stacks[r].append(b)
        open_ |= 1 << r
    count = len(room)
    for i in order:
        size = sizes[i]
        fits = open_ >> size
        if fits:
            at = (fits & -fits).bit_length() - 1 + size
            own = stacks[at]
            b = own.pop()
            if not own:
                open_ ^= 1 << at
        else:
            at, b = capacity, count
            count += 1
        bins[i] = b
        stacks[at - size].append(b)
        open_ |= 1 << (at - size)
    return bins


def _fill(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=sizes).astype(np.int64)


def _fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins as unevenly filled as can be."""
    fill = _fill(bins, sizes)
    return -len(fill), float(np.mean((fill / capacity) ** 2))


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator, share: float = 0.2) -> np.ndarray:
    """Bins of ``b``, the fuller the likelier, put whole into ``a``."""
    fill = _fill(b, sizes)
    count = max(1, int(share * len(fill)))
    chosen = np.zeros(len(fill), bool)
    chosen[np.argsort(-(fill / capacity) - 0.02 * rng.random(len(fill)), kind="stable")[: 2 * count][rng.permutation(min(len(fill), 2 * count))[:count]]] = True
    injected = chosen[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True
    displaced = hit[a] & ~injected
    child = np.full(len(a), -1, np.int64)
    kept = ~hit[a]
    _, child[kept] = np.unique(a[kept], return_inverse=True)
    base = child.max() + 1 if kept.any() else 0
    _, place = np.unique(b[injected], return_inverse=True)
    child[injected] = base + place
    return _insert(child, np.flatnonzero(displaced), sizes, capacity)


def fill_fully(items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of these items, longest first: each bin as full as the items left can make it.

    Sums that can be reached are the bits of one number, kept after each item.
    """
    out = []
    while items:
        first, *rest = items
        room = capacity - sizes[first]
        mask, reach = (1 << (room + 1)) - 1, [1]
        for i in rest:
            reach.append(reach[-1] | (reach[-1] << sizes[i]) & mask)
        left, own, others = reach[-1].bit_length() - 1, [first], []
        for k in range(len(rest), 0, -1):
            if reach[k - 1] >> left & 1:
                others.append(rest[k - 1])
            else:
                own.append(rest[k - 1])
                left -= sizes[rest[k - 1]]
        out.append(own)
        items = others[::-1]
    return out


def mutate(a: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator, bins: int = 8, most: int = 400) -> np.ndarray:
    """The emptiest bins and some others are opened, and their items fill bins anew.

    Bins are opened while they hold ``most`` items together, so the work has a bound.
    """
    fill, count = _fill(a, sizes), np.bincount(a)
    order = np.unique(np.concatenate((np.argsort(fill, kind="stable")[: bins // 2], rng.integers(0, len(fill), bins))))
    rng.shuffle(order)
    opened = np.zeros(len(fill), bool)
    opened[order[np.cumsum(count[order]) <= most]] = True
    if not opened.any():
        return a
    child = np.full(len(a), -1, np.int64)
    kept = ~opened[a]
    base = 0
    if kept.any():
        _, child[kept] = np.unique(a[kept], return_inverse=True)
        base = int(child.max()) + 1
    items = np.flatnonzero(~kept)
    for k, own in enumerate(fill_fully(items[np.argsort(-sizes[items], kind="stable")].tolist(), sizes.tolist(), capacity)):
        child[own] = base + k
    return child


def _insert(child: np.ndarray, items: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    there = child >= 0
    room = (capacity - np.bincount(child[there], weights=sizes[there]).astype(np.int64)).tolist() if there.any() else []
    order = items[np.argsort(-sizes[items], kind="stable")]
    return best_fit(order.tolist(), sizes.tolist(), child, room, capacity)


def evolve(sizes: np.ndarray, population: list[np.ndarray], conf: Conf, rng: np.random.Generator) -> list[np.ndarray]:
    """Some generations of one island; the best individual comes first."""
    n, plain = len(sizes), sizes.tolist()
    least = -(-int(sizes.sum()) // conf.length)
    while len(population) < conf.population:
        if population and int(population[0].max()) + 1 <= least:
            break
        noise = 1.0 if not population else 1 + 0.15 * rng.random(n)
        order = np.argsort(-sizes * noise, kind="stable").tolist()
        population.append(best_fit(order, plain, np.zeros(n, np.int64), [], conf.length))
    ranked = sorted(((_fitness(p, sizes, conf.length), i, p) for i, p in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    pool = [(f, p) for f, _, p in ranked][: conf.population]
    for _ in range(conf.generations):
        if -pool[0][0][0] <= least:
            break
        i, j = rng.permutation(len(pool))[:2] if len(pool) > 1 else (0, 0)
        child = crossover(pool[i][1], pool[j][1], sizes, conf.length, rng)
        for _ in range(1 + len(pool[0][1]) // 1000):
            child = mutate(child, sizes, conf.length, rng)
        pool.append((_fitness(child, sizes, conf.length), child))
        pool.sort(key=lambda x: x[0], reverse=True)
        pool = pool[: conf.population]
    return [p for _, p in pool]


_STATE = "block long, island int, uids binary, sizes binary, population array<binary>, bins long, least long"
_ARROW = [("block", pa.int64()), ("island", pa.int32()), ("uids", pa.binary()), ("sizes", pa.binary()), ("population", pa.list_(pa.binary())), ("bins", pa.int64()), ("least", pa.int64())]


def _round(conf: Conf, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                population = [np.frombuffer(p, np.int32).astype(np.int64) for p in row["population"]]
                rng = np.random.default_rng([abs(row["block"]), row["island"], number])
                out = evolve(sizes, population, conf, rng)
                row |= {"population": [p.astype(np.int32).tobytes() for p in out], "bins": int(out[0].max()) + 1, "least": -(-int(sizes.sum()) // conf.length)}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema(_ARROW))

    return run


def _start(conf: Conf):
    """The islands of each block, without individuals."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        block = table["block"][0].as_py()
        uids, sizes = table["uid"].to_numpy().tobytes(), table["length"].to_numpy().astype(np.int32).tobytes()
        n = conf.islands
        return pa.table(
            {
                "block": pa.array([block] * n, pa.int64()),
                "island": pa.array(range(n), pa.int32()),
                "uids": pa.array([uids] * n, pa.binary()),
                "sizes": pa.array([sizes] * n, pa.binary()),
                "population": pa.array([[]] * n, pa.list_(pa.binary())),
                "bins": pa.array([0] * n, pa.int64()),
                "least": pa.array([0] * n, pa.int64()),
            }
        )

    return run


def _places(conf: Conf, base: int, last: bool):
    """(uid, length, sequence_id, offset, loose) of the items of each block's best individual.

    Unless this is the last level, the items of a block's emptiest bin are loose: they will
    be packed again with those of other blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uids, sizes = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                bins = np.frombuffer(row["population"][0], np.int32).astype(np.int64)
                fill = _fill(bins, sizes)
                loose = (bins == fill.argmin()) & (fill.min() < conf.length) & (not last)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
                offset = before - np.maximum.accumulate(np.where(first, before, 0))
                sequence = 2 * (((base + row["block"]) << 24) + bins[order])
                yield pa.record_batch(
                    [pa.array(x) for x in (uids[order], sizes[order], sequence, offset, loose[order])], names=["uid", "length", "sequence_id", "offset", "loose"]
                )

    return run


def _search(short: DataFrame, blocks: int, base: int, conf: Conf) -> DataFrame:
    """Places of the items (uid, length), packed in ``blocks`` blocks by islands.

    Rounds end early when every block has an island at the least number of bins there can be.
    """
    spark = short.sparkSession
    dealt = short.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    islands = written(dealt.groupBy("block").applyInArrow(_start(conf), _STATE).mapInArrow(_round(conf, 0), _STATE), "islands")
    for number in range(1, conf.rounds):
        if islands.groupBy("block").agg(F.min(F.col("bins") - F.col("least")).alias("over")).where("over > 0").isEmpty():
            break
        elite = islands.select("block", F.pmod(F.col("island") + 1, F.lit(conf.islands)).cast("int").alias("island"), F.slice("population", 1, 1).alias("elite"))
        met = islands.join(elite, ["block", "island"])
        joined = met.withColumn("population", F.concat("elite", "population")).select(*islands.columns)
        after = written(joined.mapInArrow(_round(conf, number), _STATE), "islands")
        drop(spark, islands)
        islands = after
    best = islands.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("best")).select("block", F.col("best.island").alias("island"))
    schema = "uid long, length long, sequence_id long, offset long, loose boolean"
    places = written(islands.join(best, ["block", "island"]).mapInArrow(_places(conf, base, blocks == 1), schema), "places")
    drop(spark, islands)
    return places


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", conf: Conf = Conf()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
    pieces = written(rows.mapInArrow(_pieces(tokenizer, conf), schema), "pieces")
    short, base = pieces.where(F.col("length") < conf.length).select("uid", "length"), 0
    places, settled = None, []
    while places is None or settled[-1][1] > 1:
        blocks = max(1, -(-short.count() // conf.block))
        places = _search(short, blocks, base, conf)
        settled.append((places.where("not loose").select("uid", "sequence_id", "offset"), blocks))
        short, base = places.where("loose").select("uid", "length"), base + blocks
    placed = functools.reduce(DataFrame.unionByName, [p for p, _ in settled])
    full = pieces.where(F.col("length") == conf.length).withColumn("sequence_id", 2 * F.col("uid") + 1).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < conf.length).join(placed, "uid")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(*columns).unionByName(rest.select(*columns))
