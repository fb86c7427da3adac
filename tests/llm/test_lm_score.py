import math
import random
import re
from collections import Counter

from noticeflow.llm import lm_score


def brute(docs, good, conf):
    low = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in docs}
    counts = Counter(w for ws in low.values() for w in ws)
    vocabulary = set(counts) if len(counts) <= conf.words else None
    assert vocabulary is not None, "the fixture keeps the vocabulary whole"
    size = len(vocabulary)

    def model(ids):
        pairs = Counter()
        for i in ids:
            for a, b in zip(["<s>", *low[i]], low[i], strict=False):
                pairs[a, b] += 1
        uni, ctx = Counter(), Counter()
        for (a, b), n in pairs.items():
            uni[b] += n
            ctx[a] += n
        total = sum(uni.values())

        def loss(a, b):
            u = (uni[b] + 1) / (total + size + 1)
            return -math.log((pairs[a, b] + conf.prior * u) / (ctx[a] + conf.prior))

        return loss

    target, background = model([i for i, _ in docs if i in good]), model([i for i, _ in docs])
    out = {}
    for i, ws in low.items():
        d = [target(a, b) - background(a, b) for a, b in zip(["<s>", *ws], ws, strict=False)]
        out[i] = (len(d), sum(d) / len(d) if d else 0.0)
    return out


def test_matches_brute_force(spark, words):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(words[: 100 + 3 * i]) for _ in range(rng.randint(0, 40)))) for i in range(80)]
    good = {i for i, _ in docs if i % 3 == 0}
    conf = lm_score.Conf(words=500, prior=7.0)
    got = lm_score.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i,) for i in good] + [(None,)], "doc_id long"), conf=conf).collect()
    want = brute(docs, good, conf)
    for r in got:
        assert r.n_tokens == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-5


def test_every_word_is_in_the_model(spark):
    """3,000 words, each seen as often as any: no two documents may look alike."""
    docs = [(i, " ".join(f"w{(7 * i + j) % 3000}" for j in range(20))) for i in range(600)]
    good = {i for i, _ in docs if i % 3 == 0}
    whole = brute(docs, good, lm_score.Conf(words=3000))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i,) for i in good], "doc_id long")

    def same(got):
        return len(got) == 600 and all(r.n_tokens == whole[r.doc_id][0] and abs(r.score - whole[r.doc_id][1]) < 1e-5 for r in got)

    assert same(lm_score.score(*frames).collect())
    assert same(lm_score.score(*frames, conf=lm_score.Conf(block=9_000)).collect())


def test_odd_rows(spark, odd, odd_rows, empty):
    got = lm_score.score(odd, odd.select("doc_id").limit(0)).collect()
    assert len(got) == len(odd_rows)
    assert all(r.score == 0 and r.n_tokens == 0 for r in got if r.doc_id in (None, 1, 2, 3))
    assert lm_score.score(empty, empty.select("doc_id")).collect() == []


def test_small_vocabulary_has_an_unknown_word(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "a c d")], "doc_id long, text string")
    rows = lm_score.score(docs, docs.where("doc_id = 1").select("doc_id"), conf=lm_score.Conf(words=1)).collect()
    scores = {r.doc_id: r.score for r in rows}
    assert scores[1] < scores[2]
