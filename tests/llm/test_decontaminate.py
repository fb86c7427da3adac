import random

import numpy as np

from noticeflow.llm import decontaminate as d


def naive(a, b, conf=d.Align()):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = conf.match if a[i - 1] == b[j - 1] else conf.mismatch
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + conf.gap, h[i][j - 1] + conf.gap)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 30))
        assert d.smith_waterman(a, b)[0] == naive(a.tolist(), b.tolist())


def planted(words):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(12, 40)))) for k in range(12)] + [(12, None), (13, ""), (None, "x y z"), (14, "solo item")]
    docs, want = [], set()
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 150))]
        if i % 3 == 0:
            k = rng.randrange(12)
            copy = items[k][1].split()
            if i % 2:
                for _ in range(len(copy) // 8):
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = rng.choice([[], [rng.choice(words)], [copy[at], rng.choice(words)]])
            at = rng.randint(0, len(w))
            w[at:at] = [c.upper() + "," if rng.random() < 0.3 else c for c in copy]
            want.add((i, k))
        docs.append((i, " ".join(w)))
    return docs, items, want


def test_copies_are_found_and_others_left(spark, words):
    docs, items, want = planted(words)
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find(a, b).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in d.find(a, b, conf=d.Align(block=4)).collect()} == want


def test_an_item_in_every_document_keeps_its_seeds(spark, words):
    rng = random.Random(3)
    item = " ".join(rng.choice(words) for _ in range(25))
    docs = [(i, " ".join(rng.choice(words) for _ in range(30)) + " " + item) for i in range(50)]
    found = d.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found.count() == 50


def test_a_copy_edited_in_every_fourth_word_is_found(spark, words):
    rng = random.Random(7)
    item = rng.sample(words, 32)
    copy = [f"edited{i}" if i % 4 == 3 else w for i, w in enumerate(item)]
    docs = [(i, " ".join([rng.choice(words) for _ in range(40)] + (copy if i == 0 else []))) for i in range(30)]
    found = d.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(0, 1)] and 0.6 < found[0].score < 0.7


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, "quite another set of words here")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.find(odd, items).collect()] == [(4, 1), (4, 1)]
    assert d.find(empty, items).collect() == [] and d.find(odd, items.limit(0)).collect() == []
