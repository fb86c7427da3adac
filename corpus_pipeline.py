"""The corpus pipeline: quality, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All
but the last return the columns that they were given.

Verdicts meet rows by id and content, so they hold for rows without an id, too: a row that
is rejected goes whatever its id.  Of equal rows, and of rows of a group of near copies, one
stays: that of the least id, and of the least content hash among several of one id.  Rows
without an id that are like no other stay.  Null and empty texts fail the quality rules.  Empty
tables give empty results.  Other columns, whatever their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm import decontaminate, ngram_join, packing, pii, quality_rules

_KEY = "_pipeline_key"


def _key() -> Column:
    """A row's id and content."""
    return F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text", "lang", "source").cast("string"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose key is in ``gone``.

    The side that is hashed holds distinct keys, some fifty bytes each and dealt evenly, so
    it is always smaller than the texts of the same partition.
    """
    return docs.withColumn(_KEY, _key()).join(gone.select(_KEY).distinct().hint("shuffle_hash"), _KEY, "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _without(docs, quality_rules.judge(docs.withColumn(_KEY, _key()), key=_KEY).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, and of equal rows, one document stays."""
    found = ngram_join.join(docs.select("doc_id", "text", _key().alias(_KEY)), more=(_KEY,))
    group = F.coalesce(F.col("component_id").cast("string"), F.col(_KEY))
    found = found.select(group.alias("group"), F.struct("doc_id", _KEY).alias("at"))
    # Both aggregates begin in each task, so a large group sends few rows.
    least = found.groupBy("group").agg(F.min(F.when(F.col("at.doc_id").isNotNull(), F.col("at"))).alias("first"), F.min("at").alias("any"))
    kept = found.groupBy("group", "at").agg(F.count(F.lit(1)).alias("copies")).join(least.select(F.coalesce("first", "any").alias("at"), F.lit(True).alias("stays")), "at", "left")
    told = kept.where("stays is null or copies > 1").select(F.col(f"at.{_KEY}").alias(_KEY), "stays").distinct().hint("shuffle_hash")
    rows = docs.withColumn(_KEY, _key()).join(told.select(_KEY, F.coalesce("stays", F.lit(False)).alias("_verdict")), _KEY, "left")
    once = rows.where("_verdict is null").select(*docs.columns)
    return once.unionByName(rows.where("_verdict").dropDuplicates([_KEY]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontaminate.find(docs.withColumn(_KEY, _key()), items, key=_KEY))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and lengths follow."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Alignment, message passing and the genetic search have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    from noticeflow.llm.storage import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
