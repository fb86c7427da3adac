import random
import re
import sys

import numpy as np
import pytest

from noticeflow.llm import ngram_join
from noticeflow.llm.components import components, forest


def brute(rows):
    sets = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    pairs = [(a, a) for a in ids]
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                pairs.append((a, b))
    roots = forest(pairs)
    return {i: (len(sets[i]), roots[i]) for i in ids}


def corpus(words, seed):
    rng = random.Random(seed)
    passage = [rng.choice(words) for _ in range(60)]
    rows, base = [], [rng.choice(words) for _ in range(90)]
    for i in range(160):
        kind = i % 8
        if kind == 0:
            w = [rng.choice(words) for _ in range(rng.randint(1, 16))]
        elif kind in (1, 2):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 3:
            w = [rng.choice(words) for _ in range(rng.randint(0, 60))] + passage
        elif kind == 4 and rows:
            w = rows[rng.randrange(len(rows))][1].split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 5:
            w = base[: rng.randint(3, 14)] + [rng.choice(words)] * rng.randint(0, 2)
        else:
            w = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,conf", [(1, ngram_join.Join()), (2, ngram_join.Join(frequent=2, short=4, block=4000)), (3, ngram_join.Join(frequent=3, max_frequent=5, largest_small=0, block=20_000))])
def test_matches_brute_force(spark, words, seed, conf):
    rows = corpus(words, seed)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), conf=conf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_odd_rows(spark, odd, odd_rows, empty):
    got = ngram_join.join(odd).collect()
    assert len(got) == len(odd_rows)
    want = brute([(i, t) for i, t, *_ in odd_rows if i is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert ngram_join.join(empty).collect() == []


def test_overlaps_by_lists():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 90)).astype(np.uint64)) for _ in range(90)]
    got = ngram_join.overlaps(sets)
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_subset_keys_and_boundary():
    conf = ngram_join.Join()
    assert conf.overlaps(5, 12) == [4, 5] and conf.first(10) == 3 and conf.need(4, 5) == 4
    assert ngram_join.boundary(conf, {}, 1.0) == 0
    assert ngram_join.boundary(conf, {5: 1000, 6: 1000}, 50.0) >= 6


def test_unfinished_components_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(sys.modules[components.__module__], "SHARE", 10)
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long").repartition(8)
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 7), (1, 2), (2, 1), (3, 20), (20, 21), (21, 22), (22, 4), (4, 3)]
    chain = [(100 + i, 101 + i) for i in range(40)]
    got = components(spark.createDataFrame(edges + chain, "a long, b long").repartition(5)).collect()
    assert {r.node: r.root for r in got} == {x: r for x, r in forest(edges + chain).items()}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_large_groups_of_near_copies(spark, words):
    """Shared shingles follow each other into the first parts: no list of them is gathered."""
    rng = random.Random(12)
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words) + str(i)
        rows.append((i, " ".join(w)))
    # Relatives of the group that do not link with all of it, and some that link with none.
    for i in range(700, 760):
        w = list(base)
        at = rng.randrange(160)
        w[at : at + rng.randint(15, 40)] = [rng.choice(words) + str(i) for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(w)))
    conf = ngram_join.Join(frequent=8, short=16, block=60_000)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), conf=conf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_long_lists_may_be_joined(spark, words):
    rows = corpus(words, 5)
    conf = ngram_join.Join(frequent=2, short=4, block=4000, max_broadcast=0)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), conf=conf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_hubs(spark, monkeypatch):
    from noticeflow.llm import components as c

    monkeypatch.setattr(c, "FEW", 5)
    monkeypatch.setattr(c, "HUBS", 50)
    monkeypatch.setattr(c, "SHARE", 100)
    rng = random.Random(3)
    pairs = [(0, i) for i in range(1, 200)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = forest(pairs)
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


def shuffled(spark):
    """Bytes that all tasks have written for shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    known = sc.statusStore().executorList(False)
    return sum(known.apply(i).totalShuffleWrite() for i in range(known.size()))


def test_texts_without_candidates_are_not_shuffled(spark):
    rng = random.Random(7)
    docs = [(i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(300))) for i in range(300)]
    docs += [(1000 + i, docs[i][1] + " and more") for i in range(3)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).localCheckpoint()
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = shuffled(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {r.doc_id: r.component_id for r in ngram_join.join(table).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert got == {i: i % 1000 for i, _ in docs}
    assert shuffled(spark) - before < 1.3 * sum(len(t) for _, t in docs)


@pytest.mark.parametrize("most", [1, 500_000])
def test_texts_of_ids(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "MOST_WORDS", most)
    docs = spark.createDataFrame([(i % 900 - 20, str(i)) for i in range(1000)] + [(None, "null")], "doc_id long, text string")
    ids = spark.createDataFrame([(i, [str(i)]) for i in range(-50, 2000, 7)], "doc_id long, blocks array<string>")
    got = sorted((r.doc_id, r.text, r.blocks) for r in ngram_join._texts(docs, ids).collect())
    assert got == sorted((i % 900 - 20, str(i), [str(i % 900 - 20)]) for i in range(1000) if (i % 900 + 30) % 7 == 0)
    assert ngram_join._texts(docs, ids.limit(0)).collect() == []
