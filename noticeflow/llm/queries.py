"""Queries of the training-data operators, by contract, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import decontaminate, lm_score, ngram_join, packing, pii, quality_rules, quality_sql, secret_scan, storage, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages, storage.new_path(spark, "warc"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.Training.threshold).cast("int").alias("predicted"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_score.score(_table(spark, sf_dir, "documents"), good)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_lm_score": op5_lm_score,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_join": op8_ngram_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL = {
    "op7_quality_rules": quality_sql.sql(),
    "op2_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
        ), d AS (
            SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op8_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(
                regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE
                WHEN len(words) = 0 THEN []
                WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
            END) AS shingles
            FROM w
        ), n AS (
            SELECT doc_id, len(shingles) AS n FROM s
        ), e AS (
            SELECT doc_id, unnest(shingles) AS shingle FROM s
        ), o AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k
            FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
        ), l AS (
            SELECT u, v FROM o JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)
        ), r AS (
            SELECT doc_id, doc_id AS seen FROM n
            UNION
            SELECT r.doc_id, l.v AS seen FROM r JOIN l ON l.u = r.seen
        ), c AS (
            SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM n JOIN c USING (doc_id)
    """,
}
