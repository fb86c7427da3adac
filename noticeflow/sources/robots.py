"""Robots rules as a table (origin, text): verdicts and delays for addresses."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(https?://[^/?#]*)", 1))


@lru_cache(maxsize=512)
def _parser(text: str) -> RobotFileParser:
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return parser


def delay_of(text: str | None, agent: str) -> float | None:
    """The longer of the two intervals that a site may ask for; none if it asks for none."""
    if text is None:
        return None
    parser, found = _parser(text), []
    wait, rate = parser.crawl_delay(agent), parser.request_rate(agent)
    if wait is not None:
        found.append(float(wait))
    if rate is not None and rate.requests > 0:
        found.append(rate.seconds / rate.requests)
    return max(found) if found else None


def checked(urls: DataFrame, robots: DataFrame, url: str = "url", agent: str = "noticeflow") -> DataFrame:
    """``urls`` (that column) with allowed and delay. No rules: allowed; not http: not.

    Rules meet addresses by origin; each worker parses a text once while it is in its cache.
    """
    rules = robots.select(F.lower("origin").alias("_origin"), F.col("text").alias("_text"))
    rows = urls.select(F.col(url).alias("url"), origin(F.col(url)).alias("_origin")).join(rules, "_origin", "left").select("url", "_origin", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            allowed, delays = [], []
            for u, o, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                allowed.append(bool(o) and (text is None or _parser(text).can_fetch(agent, u)))
                delays.append(delay_of(text, agent) if o else None)
            yield pa.record_batch([batch.column(0), pa.array(allowed, pa.bool_()), pa.array(delays, pa.float64())], names=["url", "allowed", "delay"])

    return rows.mapInArrow(run, "url string, allowed boolean, delay double")
