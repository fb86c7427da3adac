"""Feeds: RSS and Atom by a parser on the executors, JSON by SQL functions."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import text as T

ROWS = "src_idx int, item_idx int, title string, url string, published string, summary string"
_DATES = ("pubDate", "published", "updated", "date", "issued", "created", "modified", "lastBuildDate")


def _plain(raw: str | None, longest: int) -> str:
    text = " ".join(unescape(re.sub(r"<[^>]*>", " ", raw or "")).split())
    return text if len(text) <= longest else text[: longest - 1].rstrip() + "…"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def parse_feed(data: bytes | None) -> list[tuple[str, str, str, str]]:
    """(title, link, date text, summary) of the items; none if it declares entities."""
    text = (data or b"").decode("utf-8", "replace").lstrip("﻿ \r\n\t")
    if not text or re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.I):
        return []
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return []
    items = [e for e in root.iter() if _name(e.tag) == "item"] or [e for e in root.iter() if _name(e.tag) == "entry"]
    out = []
    for item in items:
        fields: dict[str, str] = {}
        links = []
        for child in item:
            name, value = _name(child.tag), "".join(child.itertext()).strip()
            if name == "link":
                links.append((child.get("rel", "alternate"), value or child.get("href", "").strip()))
            if value:
                fields.setdefault(name, value)
        link = next((u for rel, u in links if rel == "alternate" and u), next((u for _, u in links if u), ""))
        title = _plain(fields.get("title"), 200)
        if title and link:
            when = next((fields[d] for d in _DATES if d in fields), "")
            out.append((title, link, when, _plain(fields.get("description") or fields.get("summary") or fields.get("content"), 280)))
    return out


def _feed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["src_idx", "item_idx", "title", "url", "published", "summary"]
    for batch in batches:
        rows = [(s, i, *item) for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, item in enumerate(parse_feed(data))]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        kinds = [pa.int32(), pa.int32(), *[pa.string()] * 4]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def rss(captured: DataFrame) -> DataFrame:
    """Notices of captured feeds (src_idx, bytes); malformed feeds give none."""
    rows = captured.select(F.col("src_idx").cast("int"), F.col("bytes").cast("binary")).mapInArrow(_feed_rows, ROWS)
    rfc = F.regexp_extract("published", r"([0-9]{1,2} [A-Z][a-z]{2} [0-9]{4})", 1)
    return rows.withColumn("published", F.coalesce(T.parse_date(F.col("published")), F.try_to_date(rfc, "d MMM yyyy")))


_FIELDS = {
    "title": ("title", "nttSj", "bbsNm", "sj"),
    "url": ("url", "link", "detailUrl", "nttUrl"),
    "published": ("pubDate", "regDate", "date", "frstRegistPnttm", "createdDt"),
    "summary": ("summary", "description", "content", "nttCn"),
}


def open_data(captured: DataFrame, column: str = "json") -> DataFrame:
    """Notices of open-data replies (src_idx, json): nested items (one or many), or data."""
    doc = F.try_parse_json(F.col(column))
    items = F.coalesce(
        F.try_variant_get(doc, "$.response.body.items.item", "array<variant>"),
        F.transform(F.array(F.try_variant_get(doc, "$.response.body.items.item", "variant")), lambda v: v),
    )
    many = F.when(F.try_variant_get(doc, "$.response.body.items.item", "variant").isNotNull(), items)
    rows = F.coalesce(many, F.try_variant_get(doc, "$.data", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    each = captured.select("src_idx", F.posexplode(rows).alias("item_idx", "row"))

    def first(names) -> Column:
        return F.coalesce(*(F.nullif(F.trim(F.try_variant_get("row", f"$.{n}", "string")), F.lit("")) for n in names), F.lit(""))

    out = each.select("src_idx", "item_idx", *(first(names).alias(c) for c, names in _FIELDS.items())).where("title <> ''")
    return out.withColumn("published", T.parse_date(F.col("published"))).withColumn("title", T.clean_text(F.col("title"), 200)).withColumn("summary", T.clean_text(F.col("summary")))
