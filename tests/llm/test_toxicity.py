import random

import numpy as np
import pyarrow as pa

from noticeflow.llm import textvec as tv
from noticeflow.llm import toxicity as tox

SMALL = tox.Training(buckets=1 << 14, epochs=40, min_texts=1)


def sample(words, count, seed, bad):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        w = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return rows


def test_features_are_words_and_ngrams():
    (chunk,) = tv.chunks(pa.array(["aé b", "", "aé"]))
    got = [(r.tolist(), b.tolist()) for r, b in tox.features(chunk, 1 << 20)]
    assert got[0][0] == [0, 0, 2] and got[0][1][0] == got[0][1][2]
    # <aé> has two trigrams and one of four, <b> one trigram.
    assert sorted(got[1][0]) == [0, 0, 0, 2, 2] and got[2][0] == [0, 2] and got[3][0] == []


def test_unseen_misspellings(words):
    bad = ["wretched", "horrible", "disgrace"]
    rows = sample(words, 400, 1, bad)
    model = tox.train(pa.array([t for _, t, _ in rows]), np.array([y for _, _, y in rows]), SMALL)
    new = sample(words, 200, 2, ["wretchedd", "horribble", "disgracee"])
    p = tox.scores(pa.array([t for _, t, _ in new]), model)
    y = np.array([y for _, _, y in new])
    assert ((p >= 0.3) == y).mean() > 0.9


def test_dataframes(spark, odd, odd_rows, empty, words):
    rows = sample(words, 200, 3, ["wretched"])
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = tox.fit(docs, labels, SMALL)
    got = tox.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (None, 1, 2, 3)}) == 1
    assert tox.score(empty, model).collect() == []
    none = tox.fit(docs, labels.limit(0), SMALL)
    assert tox.score(docs, none).where("score < 0.3").count() == len(rows)


def test_held_out_accuracy(spark, sf):
    from noticeflow.llm import queries

    rows = queries.op4_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = rows.join(labels, "doc_id").where("held_out").selectExpr("int(predicted = 1 and toxic = 1) tp", "int(predicted = 1 and toxic = 0) fp", "int(predicted = 0 and toxic = 1) fn").groupBy().sum().head()
    assert got[0] >= 0.8 * (got[0] + got[2]) and got[0] >= 0.7 * (got[0] + got[1])
