"""The quality rules as SQL for DuckDB."""

from __future__ import annotations

from noticeflow.llm.quality_rules import _DIGITS, _ODD, _POINTS, _UPPER, COMMON_WORDS, SYMBOLS, Thresholds


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _distance(counts: list[str], total: str, shares: list[str]) -> str:
    terms = []
    for c, q in zip(counts, shares, strict=True):
        p = f"({c} / {total})"
        m = f"(({p} + {q}) / 2)"
        terms.append(f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2")
    return f"(CASE WHEN {total} > 0 THEN sqrt(greatest({' + '.join(terms)}, 0)) ELSE 0 END)"


def sql(t: Thresholds = Thresholds()) -> str:
    count = lambda chars: f"length(t) - length(translate(t, {_q(chars)}, ''))"
    tokens = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    word = {w: f"w{i}" for i, w in enumerate(tokens)}
    classes = ["upper", "digit", "point", "odd", "other"]
    refs, near = [], []
    for lang, own in COMMON_WORDS.items():
        sums = [f"sum({c}) / sum(word_chars) AS {lang}_{c}" for c in classes]
        sums += [f"sum({word[w]}) / sum(n_words) AS {lang}_{word[w]}" for w in own]
        rest = f"(n_words - {' - '.join(word[w] for w in own)})"
        sums.append(f"sum({rest}) / sum(n_words) AS {lang}_rest")
        refs.append(f"{lang} AS (SELECT {', '.join(sums)} FROM m WHERE lang = '{lang}')")
        c = _distance(classes, "word_chars", [f"{lang}_{c}" for c in classes])
        w = _distance([*(word[w] for w in own), rest], "n_words", [*(f"{lang}_{word[w]}" for w in own), f"{lang}_rest"])
        near.append(
            f"({lang}_rest IS NOT NULL AND (word_chars < {t.min_chars} OR {c} <= {t.class_distance}) AND (n_words < {t.min_words} OR {w} <= {t.word_distance}))"
        )
    none = " AND ".join(f"{lang}_rest IS NULL" for lang in COMMON_WORDS)
    return f"""
        WITH d AS (
            SELECT doc_id, lang, coalesce(text, '') AS t FROM documents
        ), w AS (
            SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
        ), runs AS (
            SELECT doc_id, i, words[i:i + 4] AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
        ), again AS (
            SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 5) AS r(k) GROUP BY doc_id
        ), m AS (
            SELECT doc_id, lang, len(words) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN words]), 0) AS BIGINT) AS word_chars,
                   {count(SYMBOLS)} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   {count(_UPPER)} AS upper, {count(_DIGITS)} AS digit, {count(_POINTS)} AS point, {count(SYMBOLS + _ODD)} AS odd,
                   word_chars - upper - digit - point - odd AS other,
                   {', '.join(f"len(list_filter(words, lambda x: x = {_q(w)})) AS {c}" for w, c in word.items())}
            FROM w LEFT JOIN covered USING (doc_id)
        ), {', '.join(refs)}, b AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m, {', '.join(COMMON_WORDS)}
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND (({none}) OR {' OR '.join(near)}) AS kept
        FROM b
    """
