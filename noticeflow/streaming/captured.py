"""Captured feeds as a stream: parse, drop repeats within a watermark, count by week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.sources import feeds

SCHEMA = "src_idx int, bytes binary, captured timestamp"


def read(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of captured feeds, as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def notices(captured: DataFrame, delay: str = "7 days", now: str = "captured") -> DataFrame:
    """New notices: a link that was seen within the watermark is dropped.

    State holds one key for each link of that time, whatever the length of the stream.
    """
    rows = feeds.rss(captured.select("src_idx", "bytes"))
    rows = rows.withColumn("seen", F.current_timestamp()).withColumn("key", T.dedup_key(F.col("url"), F.lit(""), F.col("title")))
    return rows.withWatermark("seen", delay).dropDuplicatesWithinWatermark(["key"])


def weekly(events: DataFrame, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows per Monday week; a week is given once the watermark has passed it."""
    # Windows start at the epoch, a Thursday; four days later is a Monday.
    week = F.window(at, "7 days", "7 days", "4 days")
    return events.withWatermark(at, delay).groupBy(week).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("week"), "n")


def start(rows: DataFrame, path: str, checkpoint: str):
    """Appends to Parquet, exactly once, until what is there now has been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
