import math
import random
import re
from collections import Counter

from noticeflow.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall(text or "")
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in q.SYMBOLS), len(lines) - len(set(lines)), len(covered))


def texts(words):
    rng = random.Random(4)
    out = []
    for i in range(60):
        w = [rng.choice(words[: 5 + 8 * (i % 9)]) for _ in range(rng.randint(0, 120))]
        out.append(rng.choice([" ", "\n", " \n", "\t"]).join(w) + rng.choice(["", "\n\na|b", " #$ é"]))
    return out + ["a b c d e a b c d e", "a " * 30, "x\n\n x\nx\nx ", ""]


def test_counts(spark, words):
    rows = list(enumerate(texts(words)))
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in q.judge(df).collect()}
    for i, t in rows:
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_distance(spark):
    reference = [0.5, 0.25, 0.25, 0.0]
    counts = [3, 0, 1, 4]
    df = spark.createDataFrame([(counts,)], "h array<long>")
    p = [c / sum(counts) for c in counts]
    m = [(a + b) / 2 for a, b in zip(p, reference, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    got = df.select(q.js_distance(df.h, reference).alias("d")).head().d
    assert abs(got - math.sqrt((kl(p) + kl(reference)) / 2)) < 1e-9


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "to", "in", "is", "that", "for"]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeinorst") for _ in range(6)) for _ in range(200))
    rows = [(i, prose(), "en") for i in range(40)]
    rows += [(100, " ".join(w.upper() + "!!" for w in prose().split()), "en"), (101, " | ".join(w for w in prose().split() if w not in common), "en"), (102, "***".join(prose().split()), "en")]
    kept = {r.doc_id: r.kept for r in q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in (100, 101, 102))


def test_odd_rows(odd, odd_rows, empty):
    rows = q.judge(odd).collect()
    assert len(rows) == len(odd_rows)
    by = {i: t for i, t, *_ in odd_rows}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(by[r.doc_id])
    assert q.judge(empty).collect() == []
