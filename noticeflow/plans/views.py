"""Notice views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions import text as T

#: Menu labels, licence tiers and topics that the views deal to documents by id.
LABELS = ("공지사항", "채용공고", "입찰정보", "보도자료", "학사공지", "장학안내", "입학", "행사소식", "자료실", "정책", "", "READ")
TIERS = ("public_domain", "kogl_type1", "kogl_type2", "kogl_type3", "KOGL_TYPE4", "other")
TOPICS = ((), ("복지",), ("학사", "장학"), ("고용", "고용"))


def _pick(values, key) -> F.Column:
    return F.element_at(F.array(*values), (key + 1).cast("int"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notices: the first line is the title."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    topics = [F.array(*map(F.lit, t)).cast("array<string>") for t in TOPICS]
    return d.select(
        F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("src_idx"),
        F.col("doc_id").alias("item_idx"),
        F.substring(T.squeeze(F.element_at(F.split("text", "\n", 2), 1)), 1, 200).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), (F.col("doc_id") % 900).cast("string")).alias("url"),
        F.col("source").alias("agency"),
        F.when(F.col("doc_id") % 17 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 7919 % 180).cast("int"))).alias("published"),
        T.clean_text(F.col("text")).alias("summary"),
        _pick([F.lit(x) for x in LABELS], F.col("doc_id") % 12).alias("category"),
        _pick([F.lit(x) for x in TIERS], F.col("doc_id") % 6).alias("rights"),
        _pick(topics, F.col("doc_id") % 4).alias("topics"),
        F.concat(F.lit("org"), (F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 5).cast("string")).alias("org"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("site"),
    )


def order_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notices of nations."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    places = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        read("orders")
        .join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("agency"),
            F.col("r_name").alias("org"),
            F.col("o_orderdate").cast("date").alias("published"),
            F.col("o_orderpriority").alias("category"),
            F.concat_ws(" ", "o_orderpriority", "c_mktsegment", "o_orderstatus").alias("title"),
            F.col("o_orderkey").alias("item_idx"),
        )
    )


def event_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("ts").cast("date").alias("published"), F.col("event_type").alias("agency"), F.col("user_id").alias("org"), F.col("event_id").alias("item_idx"))


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


NOTICES_SQL = f"""n AS (
    SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS src_idx, doc_id AS item_idx,
           left(trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')), 200) AS title,
           'https://' || source || '.example/' || CAST(doc_id % 900 AS VARCHAR) AS url, source AS agency,
           CASE WHEN doc_id % 17 <> 0 THEN DATE '2024-01-01' + CAST(doc_id * 7919 % 180 AS INTEGER) END AS published,
           trim(regexp_replace(replace(replace(replace(replace(replace(replace(
               regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
               '\\s+', ' ', 'g')) AS whole,
           CASE WHEN length(whole) > 280 THEN rtrim(left(whole, 279)) || '…' ELSE whole END AS summary,
           ({_list(LABELS)})[1 + doc_id % 12] AS category, ({_list(TIERS)})[1 + doc_id % 6] AS rights,
           CASE doc_id % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['복지'] WHEN 2 THEN ['학사', '장학'] ELSE ['고용', '고용'] END AS topics,
           'org' || CAST(CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 5 AS VARCHAR) AS org,
           CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS site
    FROM documents
)"""
ORDERS_SQL = """o AS (
    SELECT n_name AS agency, r_name AS org, CAST(o_orderdate AS DATE) AS published, o_orderpriority AS category,
           o_orderpriority || ' ' || c_mktsegment || ' ' || o_orderstatus AS title, o_orderkey AS item_idx
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""
