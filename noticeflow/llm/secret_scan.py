"""Secret scans: known shapes, and Shannon entropy in a sliding window. SQL functions only.

Base kinds are regular expressions.  The method looks at candidate strings (runs of key
characters), takes the character class of each - digits, hexadecimal, letters, or mixed as
in base64 - and slides a window over it.  Per step one count goes down and one goes up, and
the sum of c*log2(c) follows from those two counts, so that the entropy ``log2(w) - sum/w``
costs no recount.  A candidate whose highest window entropy reaches the threshold of its
class becomes a span unless the allow list names it or a base span overlaps it.

Null and empty texts have no spans.  Rows are kept one for one, repeated or not; an empty
table gives an empty result.  An entropy that equals the threshold passes.  Candidates of
any length are judged whole, in pieces that overlap by a window, in time linear in the text.
Only the columns ``secret_base`` and ``secret_spans`` give way to results of those names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.hof import let, spans, upto

# The base shapes.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_digits", "entropy_hex", "entropy_letters", "entropy_mixed")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"


@dataclass(frozen=True)
class Limits:
    """Window length, least entropy (bits) per class, and strings that are no secrets."""

    window: int = 20
    digit_bits: float = 2.8
    hex_bits: float = 2.8
    letter_bits: float = 3.75
    mixed_bits: float = 3.6
    allow: tuple[str, ...] = (
        r"(?i)example|sample|dummy|placeholder|changeme",
        r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
        r"0123456789|abcdefghij|ABCDEFGHIJ",
        r"^[A-Za-z]+([-_/][A-Za-z]+)+$",
        r"^[-=_+/]+$",
    )


def peak_entropy(word: Column, window: int, piece: int = 200) -> Column:
    """The highest entropy of any window of that length; of the whole word if it is shorter.

    ``word`` is ASCII.  The state holds one sum; how often the character that leaves and the
    one that comes are in the window is read off the window's own characters.
    """
    value = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    # What a character adds when it is there for the c-th time.
    adds = F.array(*(F.lit(value[c] - value[c - 1]) for c in range(1, window + 1)))
    times = lambda part, c: F.length(part) - F.length(F.replace(part, c, F.lit("")))

    def least_sum(w: Column) -> Column:
        width = F.least(F.length(w), F.lit(window))

        def step(acc: Column, i: Column) -> Column:
            leaves = F.element_at(adds, times(F.substring(w, i - window, F.lit(window)), F.substring(w, i - window, F.lit(1))))
            stay = F.substring(w, F.greatest(i - window + 1, F.lit(1)), F.least(i - 1, F.lit(window - 1)))
            comes = F.element_at(adds, times(stay, F.substring(w, i, F.lit(1))) + 1)
            return let(
                acc["sum"] - F.when(i > window, leaves).otherwise(F.lit(0.0)) + comes,
                lambda s: F.struct(s.alias("sum"), F.when(i >= width, F.least(acc["best"], s)).otherwise(acc["best"]).alias("best")),
            )

        start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("best"))
        return F.aggregate(upto(F.length(w)), start, step)["best"]

    def whole(w: Column) -> Column:
        width = F.least(F.length(w), F.lit(window))
        # Pieces overlap, so that each window is in one of them.
        pieces = F.regexp_extract_all(w, F.lit(f"(?=(.{{1,{piece}}})).{{1,{piece - window + 1}}}"), F.lit(1))
        sums = F.transform(F.filter(pieces, lambda p: F.length(p) >= width), lambda p: least_sum(p))
        return F.log2(width.cast("double")) - F.array_min(sums) / width

    return let(word, whole)


def _entropy_spans(text: Column, base: Column, limits: Limits) -> Column:
    """Array of (start, kind index, end) of candidates that pass."""

    def judged(c: Column) -> Column:
        word = F.substring(text, c["start"] + 1, c["end"] - c["start"])

        def verdict(w: Column) -> Column:
            digit, letter = w.rlike(r"[0-9]"), w.rlike(r"[A-Za-z]")
            kind = (
                F.when(w.rlike(r"^[0-9]+$"), 3)
                .when(w.rlike(r"^[A-Za-z]+$"), 5)
                .when(w.rlike(r"^[0-9a-fA-F]+$"), 4)
                .when(digit & letter, 6)
            )
            listed = F.lit(False)
            for pattern in limits.allow:
                listed = listed | w.rlike(pattern)
            bits = F.array(*map(F.lit, (limits.digit_bits, limits.hex_bits, limits.letter_bits, limits.mixed_bits)))
            ok = lambda k: F.when(k.isNull() | listed, False).otherwise(peak_entropy(w, limits.window) >= F.element_at(bits, k - 2))
            return let(kind, lambda k: F.when(ok(k), k).otherwise(-1))

        return F.struct(c["start"].alias("start"), let(word, verdict).alias("kind"), c["end"].alias("end"))

    fresh = F.filter(
        spans(text, CANDIDATE),
        lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return F.filter(F.transform(fresh, judged), lambda s: s["kind"] >= 0)


def _base(value: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind index, end) of a base kind: matches whose group is long enough."""
    return F.transform(
        F.filter(spans(value, pattern, group), lambda s: s["size"] >= least),
        lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")),
    )


def _text(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(found),
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_spans``: arrays of (start, kind index, end).

    Both replace columns of those names.  The base is within the spans.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    plain = F.lit(None).cast("array<struct<start:int,kind:int,end:int>>")
    parts = [_base(value, 0, ASSIGN, 2, 6), _base(value, 1, ACCESS, 0, 20), _base(value, 2, HEX, 0, 24)]
    base = F.coalesce(plain, F.concat(*parts))
    out = docs.withColumn("secret_base", base)
    return out.withColumn("secret_spans", F.concat(F.col("secret_base"), _entropy_spans(value, F.col("secret_base"), limits)))


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Per row: key, counts of the base kinds, hash of the base spans, and all spans."""
    count = lambda k: F.size(F.filter(F.col("secret_base"), lambda s: s["kind"] == k)).cast("long")
    return scan(docs.select(key, text), text, limits).select(
        key,
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text(F.col("secret_base")), 256).alias("base_sha256"),
        _text(F.col("secret_spans")).alias("spans"),
    )


def entropy(text: str) -> float:
    """Shannon entropy of a string's characters, counted directly (for tests)."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in (text.count(c) for c in set(text))) if n else 0.0
