from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from noticeflow.llm import ngram_join, pii, quality_rules, storage


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at
        at = storage.written(stage(spark, at, sf), name)
        assert at.columns == columns
        ids = [r.doc_id for r in at.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and ids
        if name == "quality":
            assert set(ids) == kept
        if name == "near_duplicates":
            groups = Counter(r.component_id for r in ngram_join.join(before).collect())
            assert len(ids) == len(groups) and set(ids) == set(groups)
        if name == "personal_data":
            field = pii.train()
            assert all(not pii.base_spans(r.text or "") for r in at.collect())
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in at.collect():
                assert r.text == pii.redact(texts[r.doc_id], pii.find(texts[r.doc_id], field)[1]) and r.n_chars == len(r.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids)


def test_odd_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, sf).collect()
        assert stage(spark, empty, sf).collect() == [], name


def test_rows_without_id_and_equal_rows(spark, words):
    import random

    rng = random.Random(21)
    text = lambda: " ".join(rng.choice(("the", "of", "and", "to", "in", *words[:40])) for _ in range(120))
    a, b, c, d = (text() for _ in range(4))
    edited = a.split()
    edited[3] = "other"
    rows = [(None, "too short"), (None, b), (None, c), (None, c), (7, a), (7, a), (8, " ".join(edited)), (9, d), (9, d), (10, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_stays", F.lit(1))
    judged = corpus_pipeline.quality(spark, docs, "")
    assert sorted(judged.select("doc_id", "text").collect(), key=str) == sorted(docs.where("length(text) > 20").select("doc_id", "text").collect(), key=str)
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    want = [(None, "too short"), (None, b), (None, c), (7, a), (9, d), (10, None), (11, "")]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)
