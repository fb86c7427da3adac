"""Quality rules: counts over the whole text, and divergence from language references.

SQL functions only.  Two histograms of each document, of character classes and of the
common words of a language, are compared with the mean histogram of each language in the
corpus by Jensen-Shannon distance (base 2, 0 to 1).  A document passes when some language
is near enough in both; texts under the minimum lengths are not held to a histogram that
they are too short for.

Null and empty texts have no words, so the base rule rejects them.  Rows are kept one for
one.  An empty table gives an empty result; without any reference only the base rule holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.hof import let, upto

# Word separators, symbols, and frequent function words of each language.
SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del"),
}

#: Character classes, by one stand-in letter each; all else is "other" (mostly letters).
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = "0123456789"
_POINTS = ".,;:'\"()-"
_ODD = "!?@[]\\^_`{}~+=/"
CLASSES = ("upper", "digit", "point", "odd", "other")


@dataclass(frozen=True)
class Thresholds:
    """Largest distances, and least sizes for a histogram to count."""

    class_distance: float = 0.25
    word_distance: float = 0.235
    min_chars: int = 400
    min_words: int = 100


def words_of(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def _lines(text: Column) -> Column:
    full = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return let(full, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def _windows(words: Column, width: int = 5) -> Column:
    """A hash for each run of ``width`` words."""
    return F.transform(upto(F.size(words) - width + 1), lambda i: F.xxhash64(*(F.element_at(words, i + j) for j in range(width))))


def _repeated(hashes: Column, width: int = 5) -> Column:
    """Words inside windows whose content occurs twice or more.

    Only if some hash is there twice are the hashes sorted, so that equal ones meet, and
    the union of their intervals measured.
    """

    def covered(h: Column) -> Column:
        tagged = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(
                s,
                lambda x, j: ((j > 0) & (F.element_at(s, F.greatest(j, F.lit(1)))["h"] == x["h"]))
                | ((j + 1 < F.size(s)) & (F.element_at(s, F.least(j + 2, F.size(s)))["h"] == x["h"])),
            )

        places = F.array_sort(F.transform(let(tagged, twice), lambda x: x["i"]))
        start = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            places,
            start,
            lambda acc, i: F.struct((i + width).alias("end"), (acc["n"] + i + width - F.greatest(i, acc["end"])).alias("n")),
        )["n"]

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the two kinds of histogram.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), class_hist
    (array<long>, by CLASSES) and word_hist (map from language to array<long>: its common
    words, then all other words).
    """
    value = F.coalesce(F.col(text), F.lit(""))
    signs = _UPPER + _DIGITS + _POINTS + SYMBOLS + _ODD
    codes = F.translate(value, signs + " \t\n\x0b\x0c\r", "A" * 26 + "0" * 10 + "." * len(_POINTS) + "#" * len(SYMBOLS) + "!" * len(_ODD))
    count = lambda s, x: F.length(F.col(s)) - F.length(F.replace(F.col(s), F.lit(x), F.lit("")))
    listed = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    rows = []
    for lang, own in COMMON_WORDS.items():
        times = [F.expr(f"(length(_f) - length(replace(_f, ' {x} ', ''))) div {len(x) + 2}") for x in own]
        rows += [F.lit(lang), F.array(*times, F.col("n_words") - sum(times[1:], times[0]))]
    odd = count("_c", "#") + count("_c", "!")
    rest = F.length("_c") - count("_c", "A") - count("_c", "0") - count("_c", ".") - odd
    # The helpers are columns that later steps use more than once, so each is computed once.
    return (
        docs.withColumn("_w", words_of(value))
        .withColumn("_h", _windows(F.col("_w")))
        .withColumn("_f", F.concat(F.lit(" "), F.array_join(F.filter("_w", lambda x: x.isin(listed)), "  "), F.lit(" ")))
        .withColumn("_c", codes)
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length("_c").cast("long"))
        .withColumn("n_symbols", count("_c", "#").cast("long"))
        .withColumn("n_dup_lines", _lines(value).cast("long"))
        .withColumn("n_repeat_words", _repeated(F.col("_h")).cast("long"))
        .withColumn("class_hist", F.array(count("_c", "A"), count("_c", "0"), count("_c", "."), odd, rest).cast("array<long>"))
        .withColumn("word_hist", F.create_map(*rows))
        .drop("_w", "_h", "_f", "_c")
    )


def references(table: DataFrame, lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of each listed language over all of its rows in ``measured``.

    One row for each of the languages of COMMON_WORDS at most comes to the driver.
    """
    sums = []
    for own in COMMON_WORDS:
        for k in range(len(CLASSES)):
            sums.append(F.sum(F.element_at("class_hist", k + 1)).alias(f"c_{own}_{k}"))
        break
    kinds = F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang))
    width = {own: len(ws) + 1 for own, ws in COMMON_WORDS.items()}
    hist = F.element_at("word_hist", F.col("_lang"))
    most = max(width.values())
    got = (
        table.withColumn("_lang", kinds)
        .where("_lang is not null")
        .groupBy("_lang")
        .agg(*sums, *(F.sum(F.get(hist, F.lit(k))).alias(f"w_{k}") for k in range(most)))
        .collect()
    )
    out = {}
    first = next(iter(COMMON_WORDS))
    for r in got:
        c = [float(r[f"c_{first}_{k}"] or 0) for k in range(len(CLASSES))]
        w = [float(r[f"w_{k}"] or 0) for k in range(width[r["_lang"]])]
        if sum(c) and sum(w):
            out[r["_lang"]] = ([x / sum(c) for x in c], [x / sum(w) for x in w])
    return dict(sorted(out.items()))


def js_distance(hist: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram of counts (array) from a distribution."""

    def of(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0).cast("long"), lambda a, b: a + b).cast("double")
        out = F.lit(0.0)
        for k, q in enumerate(reference):
            p = F.element_at(h, k + 1) / total
            m = (p + q) / 2
            out = out + F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2
            if q > 0:
                out = out + q * F.log2(F.lit(q) / m) / 2
        return F.when(total > 0, F.sqrt(F.greatest(out, F.lit(0.0)))).otherwise(0.0)

    return let(hist, of)


def verdict(table: DataFrame, refs: dict, t: Thresholds = Thresholds()) -> DataFrame:
    """``measured`` rows with base_failed, class_distance, word_distance and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    pairs = [
        F.struct(
            js_distance(F.col("class_hist"), c).alias("c"),
            js_distance(F.element_at("word_hist", lang), w).alias("w"),
        )
        for lang, (c, w) in refs.items()
    ]
    near = lambda x: (
        ((F.col("word_chars") < t.min_chars) | (x["c"] <= t.class_distance)) & ((F.col("n_words") < t.min_words) | (x["w"] <= t.word_distance))
    )
    kind = "array<struct<c:double,w:double>>"
    return (
        table.withColumn("_d", F.array(*pairs).cast(kind))
        .withColumn("base_failed", base)
        .withColumn("class_distance", F.array_min(F.transform("_d", lambda x: x["c"])))
        .withColumn("word_distance", F.array_min(F.transform("_d", lambda x: x["w"])))
        .withColumn("kept", ~base & ((F.size("_d") == 0) | F.exists("_d", near)))
        .drop("_d")
    )


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", t: Thresholds = Thresholds()) -> DataFrame:
    """One row per document: key, the counts, base_failed, the distances and kept.

    The texts are measured once; the references come from the written measures, which are
    some dozens of numbers a document.
    """
    from noticeflow.llm.storage import written

    table = written(measured(docs.select(key, text, lang), text).drop(text), "quality")
    return verdict(table, references(table, lang), t).drop("class_hist", "word_hist", lang)
