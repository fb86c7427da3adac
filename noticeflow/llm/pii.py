"""Personal data: base shapes, and a skip-chain conditional random field.

Base spans are regular expressions with checks.  The field has one node for each token that
holds a digit or an ``@``; a node's label is none or a kind.  Neighbouring nodes share a
transition potential, and nodes that are the same or alike, however far apart, share a skip
potential that favours one label for all of them.  Tokens under a base span are observed.
Loopy message passing gives each other token its marginals.  A run of adjacent tokens with
one kind for label is cut into the parts that can be of that kind (digits and Luhn of cards,
octets of addresses, digits of phone numbers), and each part is a span unless a base span
overlaps it.

All weights - of nodes, transitions and skip edges - are learned together, by pseudo-
likelihood, on documents that ``training_documents`` makes from rules.  Short forms are as
often personal there as not, so what decides them is what they repeat.

Null and empty texts have no spans.  Rows are kept one for one, repeated or not; an empty
table gives an empty result; other columns are not looked at, whatever their names.  Two
labels that tie give no span.  Time is linear in the text: expressions are anchored so that
no long run is scanned again.  Memory is linear in the tokens of one text, about 150 bytes
for each that is a node.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A match cannot start inside a run of digits: if it could, it would start at the run.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
_TRIM = "\"'.,;:!?()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and (text[first - 1].isascii() and text[first - 1].isalnum() or text[first - 1] in "._%+-"):
            first -= 1
        found = _DOMAIN.match(text, at) if first < at else None
        if found:
            end = found.end()
            yield first, end
        # A run before an ``@`` that did not match cannot be part of a later match.
        end = max(end, at + 1)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), in the order of starts and then of kinds."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(word: str) -> str:
    out = re.sub(r"[0-9]+", lambda m: str(min(len(m.group()), 9)) if len(m.group()) < 5 else "N", re.sub(r"[^\W\d_]+", "a", word))
    return out[:24]


def _features(words: list[str], gaps: list[bool], i: int) -> list[str]:
    word = words[i].strip(_TRIM)
    digits = re.sub(r"[^0-9]", "", word)
    out = [f"shape={_shape(word)}", f"digits={min(len(digits), 20)}", f"at={'@' in word}", f"plus={word[:1] == '+'}", f"dots={min(word.count('.'), 4)}", "bias"]
    out.append(f"letters={any(c.isalpha() for c in word)}")
    if 14 <= len(digits) <= 19 and not any(c.isalpha() for c in word):
        out.append(f"luhn={luhn(digits)}")
    if i and gaps[i]:
        out.append(f"before={_shape(words[i - 1].strip(_TRIM))}")
    if i + 1 < len(words) and gaps[i + 1]:
        out.append(f"after={_shape(words[i + 1].strip(_TRIM))}")
    return out


#: A document: sentences of (token, label index).
Document = list[list[tuple[str, int]]]


def training_documents(count: int = 900, seed: int = 11) -> list[Document]:
    """Personal data in usual forms among other numbers, named in full and again in short."""
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))

    def card() -> list[str]:
        body = rng.choice("3456") + number(14)
        c = next(body + x for x in "0123456789" if luhn(body + x))
        groups = [c[i : i + 4] for i in range(0, 16, 4)]
        return rng.choice([[c], groups, ["-".join(groups)]])

    def plain() -> str:
        return rng.choice([
            f"{rng.randint(1900, 2099)}", f"{number(1)}.{number(1)}", number(rng.randint(1, 13)), f"v{number(1)}.{number(1)}.{number(1)}", f"{number(2)}%",
            f"${number(3)}.{number(2)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"{name()}{number(3)}", "AKIA" + number(4) + name().upper(),
            f"password={name()}{number(4)}", hashlib.sha1(name().encode()).hexdigest(), f"@{name()}", number(rng.randint(20, 30)), f"{number(3)}.{number(3)}",
            f"{number(3)}.{number(2)}.{number(3)}.{rng.randint(256, 999)}", number(16), f"{number(4)}",
        ])

    def thing() -> list[list[tuple[str, int]]]:
        """The mentions of one thing, first to last."""
        k = rng.random()
        again = rng.randint(1, 3)
        if k < 0.18:
            local = f"{name()}{rng.choice(['', '.' + number(2), '_' + name()])}"
            host = rng.choice([f"{name()}.com", f"mail{number(1)}.{name()}.org", f"{name()}.{name()}.net"])
            full, short = [(f"{local}@{host}", 1)], [(f"{local}@{host.partition('.')[0]}", 1)]
            return [full] + [rng.choice([full, short]) for _ in range(again)] if rng.random() < 0.7 else [[(short[0][0], rng.choice((0, 1)))]] * again
        if k < 0.26:
            return [[(".".join(str(rng.randint(1, 255)) for _ in range(4)), 2)]] * again
        if k < 0.36:
            return [[(t, 3) for t in card()]] * again
        if k < 0.62:
            a, b, c = number(3), number(3), number(4)
            full = rng.choice([["+1", f"({a})", f"{b}-{c}"], [f"+1-{a}-{b}-{c}"], [f"+44{a}{b}{c}"], ["+1", f"{a}-{b}-{c}"]])
            short = rng.choice([[f"({a})", f"{b}-{c}"], [f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"]])
            label = 4 if (told := rng.random() < 0.6) else rng.choice((0, 4))
            return ([[(t, 4) for t in full]] if told else []) + [[(t, label) for t in short] for _ in range(again)]
        return [[(plain(), 0)]] * rng.choice((1, 1, 2))

    out = []
    for _ in range(count):
        mentions = [m for _ in range(rng.randint(1, 5)) for m in thing()]
        rng.shuffle(mentions)
        sentences: Document = []
        for m in mentions:
            if sentences and rng.random() < 0.2:
                sentences[-1] += m
            else:
                sentences.append(list(m))
        out.append(sentences)
    return out


@dataclass
class Field:
    """Weights: feature to label scores, transitions, and the skip bonus of each label."""

    names: dict[str, int]
    nodes: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    sure: float = 0.8
    passes: int = 8

    def scores(self, words: list[str], gaps: list[bool]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for i in range(len(words)):
            at = [self.names[f] for f in _features(words, gaps, i) if f in self.names]
            out[i] = self.nodes[at].sum(axis=0)
        return out


def train(documents: list[Document] | None = None, steps: int = 250, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood: each node given its features and the labels of its neighbours."""
    documents = training_documents() if documents is None else documents
    names: dict[str, int] = {}
    rows, cols, labels, left, right, alike = [], [], [], [], [], []
    for document in documents:
        words = [w for sentence in document for w, _ in sentence]
        own = [y for sentence in document for _, y in sentence]
        gaps = [bool(i) for sentence in document for i in range(len(sentence))]
        near: list[list[int]] = [[0] * len(LABELS) for _ in words]
        for i, j in _skips(words, gaps):
            near[i][own[j]] += 1
            near[j][own[i]] += 1
        for i in range(len(words)):
            for f in _features(words, gaps, i):
                rows.append(len(labels))
                cols.append(names.setdefault(f, len(names)))
            labels.append(own[i])
            left.append(own[i - 1] if gaps[i] else -1)
            right.append(own[i + 1] if i + 1 < len(words) and gaps[i + 1] else -1)
        alike += near
    size = len(LABELS)
    hot = np.vstack((np.eye(size), np.zeros(size)))
    y, before, after, near = hot[labels], hot[left], hot[right], np.array(alike, float).reshape(-1, size)
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    w = [np.zeros((len(names), size)), np.zeros((size, size)), np.zeros(size)]
    sums = [np.full_like(x, 1e-8) for x in w]
    for _ in range(steps):
        z = np.stack([np.bincount(rows, weights=w[0][cols, k], minlength=len(y)) for k in range(size)], 1)
        z += before @ w[1] + after @ w[1].T + near * w[2]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - y) / max(len(y), 1)
        slopes = [np.stack([np.bincount(cols, weights=g[rows, k], minlength=len(names)) for k in range(size)], 1), before.T @ g + g.T @ after, (near * g).sum(axis=0)]
        for x, s, d in zip(w, sums, slopes, strict=True):
            d = d + decay * x
            s += d**2
            x -= rate * d / np.sqrt(s)
    return Field(names, *w)


def _alike(word: str) -> list[str]:
    """Keys under which a token meets the tokens that it is the same as or similar to."""
    bare = word.strip(_TRIM).lower()
    digits = re.sub(r"[^0-9]", "", bare)
    out = [f"same {bare}"]
    if len(digits) >= 7:
        out.append(f"number {digits[-7:]}")
    if "@" in bare:
        out.append(f"local {bare.partition('@')[0]}")
    return out


def _skips(words: list[str], gaps: list[bool]) -> Iterator[tuple[int, int]]:
    """Pairs of consecutive holders of a key: edges stay linear in the tokens."""
    last: dict[str, int] = {}
    for i, word in enumerate(words):
        met = set()
        for key in _alike(word):
            j = last.get(key, i)
            if j != i and j not in met and not (gaps[i] and j == i - 1):
                met.add(j)
                yield j, i
            last[key] = i


def marginals(field: Field, words: list[str], gaps: list[bool], observed: list[int], block: int = 100_000) -> np.ndarray:
    """Label probabilities by loopy message passing; ``observed`` is a label, or -1.

    Edges of a kind share one potential, and go in blocks of ``block``.
    """
    n, size = len(words), len(LABELS)
    unary = field.scores(words, gaps)
    for i, y in enumerate(observed):
        if y >= 0:
            unary[i] = -50.0
            unary[i, y] = 0.0
    chain = [(i - 1, i) for i in range(1, n) if gaps[i]]
    skips = list(_skips(words, gaps))
    bonus = np.diag(field.skip)
    beliefs = unary
    if chain or skips:
        a, b = np.array(chain + skips, np.int64).T
        kind = np.repeat([0, 1], [len(chain), len(skips)])
        # Potentials by (kind, direction); both directions of an edge are half the edges apart.
        table = np.stack((field.chain, bonus, field.chain.T, bonus))
        source, target, kind = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((kind, kind + 2))
        m = len(source)
        sent = np.zeros((m, size))
        for _ in range(field.passes):
            beliefs = unary.copy()
            np.add.at(beliefs, target, sent)
            fresh = np.empty_like(sent)
            for lo in range(0, m, block):
                at = np.arange(lo, min(lo + block, m))
                out = (beliefs[source[at]] - sent[(at + m // 2) % m])[:, :, None] + table[kind[at]]
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                fresh[at] = 0.3 * sent[at] + 0.7 * (new - new.max(axis=1, keepdims=True))
            sent = fresh
        beliefs = unary.copy()
        np.add.at(beliefs, target, sent)
    p = np.exp(beliefs - beliefs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


_WHOLE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\Z")
_WHOLE_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+\Z")
_WHOLE_PHONE = re.compile(r"[+(]?[0-9][\s().0-9-]*[0-9]\Z")


def possible(kind: int, text: str) -> bool:
    """Whether a text as a whole can be of that kind."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == 0:
        return bool(_WHOLE_EMAIL.match(text))
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p[-9:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts)
    if kind == 2:
        return bool(_WHOLE_CARD.match(text)) and 14 <= len(digits) <= 19 and luhn(digits)
    return bool(_WHOLE_PHONE.match(text)) and 7 <= len(digits) <= 15


def _parts(text: str, kind: int, run: list[tuple[int, int]], longest: int = 6) -> list[tuple[int, int, int]]:
    """Spans of a run of token places that can be of the kind, covering the most tokens."""
    best: list[tuple[int, int, int]] = [(0, 0, 0)]
    for j in range(1, len(run) + 1):
        # (tokens covered, fewest spans, first token of the span that ends here or j itself)
        option = (best[j - 1][0], best[j - 1][1], j)
        for i in range(max(0, j - longest), j):
            if possible(kind, text[run[i][0] : run[j - 1][1]]):
                option = max(option, (best[i][0] + j - i, best[i][1] - 1, i))
        best.append(option)
    out, j = [], len(run)
    while j:
        i = best[j][2]
        if i < j:
            out.append((run[i][0], kind, run[j - 1][1]))
        j = i if i < j else j - 1
    return out[::-1]


def find(text: str, field: Field) -> tuple[list, list]:
    """(base spans, all spans) as (start, kind index, end)."""
    base = base_spans(text)
    places = [m.span() for m in _TOKEN.finditer(text) if _MARK.search(m.group())]
    if not places:
        return base, base
    words = [text[s:e] for s, e in places]
    gaps = [bool(i) and text[places[i - 1][1] : places[i][0]].isspace() for i in range(len(places))]
    observed, at = [], 0
    for s, e in places:
        while at < len(base) and base[at][2] <= s:
            at += 1
        inside = [k for b, k, end in base[at : at + len(KINDS)] if b < e and end > s]
        observed.append(inside[0] + 1 if inside else -1)
    if all(y >= 0 for y in observed):
        return base, base
    p = marginals(field, words, gaps, observed)
    best = np.where(p.max(axis=1) >= field.sure, p.argmax(axis=1), 0).tolist()
    added: list[tuple[int, int, int]] = []
    run: list[tuple[int, int]] = []
    for i in range(len(places) + 1):
        free = i < len(places) and observed[i] < 0 and best[i] > 0
        if run and not (free and gaps[i] and best[i] == best[i - 1]):
            added += _parts(text, best[i - 1] - 1, run)
            run = []
        if free:
            s, e = places[i]
            left, right = len(words[i]) - len(words[i].lstrip(_TRIM.replace("(", ""))), len(words[i]) - len(words[i].rstrip(_TRIM.replace(")", "")))
            run.append((s + left, max(s + left, e - right)))
    return base, sorted(base + added)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list) -> str:
    """The text with each span replaced by its kind in brackets; overlaps by the first."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join(out) + text[at:]


def _bare(text: str) -> bool:
    """Whether a text can have no span at all."""
    return not _MARK.search(text)


def digest(docs: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts of the base kinds, hash of the base spans, and all spans."""
    field = train() if field is None else field
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, found = np.zeros((len(KINDS), batch.num_rows), np.int64), [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                if not value or _bare(value):
                    sums.append(empty)
                    found.append("")
                    continue
                base, spans = find(value, field)
                for _, k, _ in base:
                    counts[k, i] += 1
                sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                found.append(_joined(spans))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c) for c in counts), pa.array(sums, pa.string()), pa.array(found, pa.string())],
                names=[key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced; nulls stay null."""
    field = train() if field is None else field
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v if not v or _bare(v) else redact(v, find(v, field)[1]) for v in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns[:at], pa.array(values, pa.string()), *batch.columns[at + 1 :]], names=names)

    return docs.mapInArrow(run, docs.schema)
