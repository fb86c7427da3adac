"""Captured pages: anchors and board lists, by one linear HTML pass on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.functions import text as T

_QUIET = {"script", "style", "noscript", "template"}


class _Page(HTMLParser):
    """Anchors (href, text) and table rows of cells (text, href)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.anchors: list[list[str]] = []
        self.rows: list[list[list[str]]] = []
        self.quiet, self.open, self.cell = 0, None, None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in _QUIET:
            self.quiet += 1
        elif tag == "a":
            self.open = [a.get("href", "").strip(), ""] if a.get("href") else None
            if self.open:
                self.anchors.append(self.open)
                if self.cell is not None and not self.cell[1]:
                    self.cell[1] = self.open[0]
        elif tag == "tr":
            self.rows.append([])
            self.cell = None
        elif tag in ("td", "th") and self.rows:
            self.cell = ["", ""]
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag in _QUIET:
            self.quiet = max(0, self.quiet - 1)
        elif tag == "a":
            self.open = None
        elif tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.quiet:
            return
        if self.open is not None:
            self.open[1] += data
        if self.cell is not None:
            self.cell[0] += data


def parse(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def anchors_of(html: str | None, base: str | None) -> list[tuple[str, str]]:
    """(absolute http link, text) in order, first of each link."""
    out: dict[str, str] = {}
    for href, text in parse(html).anchors:
        try:
            url = urljoin(base or "", href)
            ok = urlsplit(url).scheme in ("http", "https")
        except ValueError:
            continue
        if ok and url not in out:
            out[url] = " ".join(text.split())
    return list(out.items())


def _each(parse_one, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(key, i, *r) for i, r in enumerate(parse_one(html, url))]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * (len(names) - 2)]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, text) of the links of captured pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_each(anchors_of, ["page_id", "pos", "url", "text"]), "page_id long, pos int, url string, text string")


# File kinds by ending; words, in label or address, of links to related files;
# and labels that name nothing.
_KINDS = {
    ".pdf": "PDF", ".hwp": "HWP", ".hwpx": "HWP", ".doc": "DOC", ".docx": "DOC", ".xls": "XLS", ".xlsx": "XLS", ".ppt": "PPT", ".pptx": "PPT",
    ".zip": "ZIP", ".csv": "CSV",
}
LINK_HINTS = ("첨부", "붙임", "다운로드", "download", "관련자료", "관련 자료", "fileDown", "file_down")
NOISE_LABELS = ("", "바로가기", "more", "더보기", "목록", "이전", "다음", "인쇄", "공유")


def attachment_kind(url: Column) -> Column:
    """The kind of file an address ends in, before any query; else empty."""
    out = F.lit("")
    for ext, kind in _KINDS.items():
        out = F.when(F.lower(url).rlike(rf"\{ext}(?:$|[?#])"), kind).otherwise(out)
    return out


def deep_links(links: DataFrame, most: int = 5) -> DataFrame:
    """The first links of each page to related files: (page_id, place, label, url, kind).

    ``links`` are anchors; a label that names nothing gives way to the file's name.
    """
    label = F.substring(F.trim("text"), 1, 60)
    label = F.when(F.lower(label).isin(*NOISE_LABELS), "").otherwise(label)
    text = F.lower(F.concat_ws(" ", "url", "label"))
    hinted = F.lit(False)
    for hint in LINK_HINTS:
        hinted = hinted | text.contains(hint.lower())
    kind = attachment_kind(F.col("url"))
    name = F.substring(F.element_at(F.split(F.element_at(F.split("url", r"[?#]"), 1), "/"), -1), 1, 60)
    rows = links.withColumn("label", label).withColumn("kind", F.when(kind != "", kind).when(hinted, "링크")).where("kind is not null")
    rows = rows.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.nullif(name, F.lit("")), F.lit("첨부")))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("page_id", "place", "label", "url", "kind")


def mined_urls(captured: DataFrame, most: int = rules.MOST_MINED) -> DataFrame:
    """(page_id, place, url, score) of addresses in a page's source that look like boards.

    ``captured`` has page_id, url and html.  Addresses on the same site that are no files and
    have a score above 0, the best first; relative ones are joined with the page's own.
    """
    base = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    raw = F.regexp_extract_all(F.replace("html", F.lit("\\/"), F.lit("/")), F.lit(rules.URL_LITERAL), F.lit(1))
    each = captured.select("page_id", T.host(F.col("url")).alias("home"), base.alias("base"), F.explode(F.array_distinct(raw)).alias("raw")).where(~F.col("raw").startswith("//"))
    whole = F.when(F.col("raw").startswith("/"), F.concat("base", "raw")).otherwise(F.col("raw"))
    rows = each.select("page_id", "home", F.regexp_replace(whole, "#.*$", "").alias("url")).distinct()
    path, host = F.lower(T.path(F.col("url"))), T.bare_host(T.host(F.col("url")))
    asset = F.lit(False)
    for tail in rules.ASSET_TAILS:
        asset = asset | path.endswith(tail)
    own = T.bare_host(F.col("home"))
    known = F.lit(False)
    for x in rules.EXTERNAL_HOSTS:
        known = known | (host == x) | host.endswith("." + x)
    inside = ((host == own) | host.endswith(F.concat(F.lit("."), own))) & ~known
    scored = rows.where(inside & ~asset & ~path.isin("", "/")).withColumn("score", T.board_score(F.col("url"), F.lit(""))).where("score > 0")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "url"))
    return scored.withColumn("place", place).where(F.col("place") <= most).select("page_id", "place", "url", "score")


def is_feed(data: Column) -> Column:
    """Whether bytes are a feed: its root early on, and a part of its body."""
    text = lambda n: F.decode(F.substring(data, 1, n), "ISO-8859-1")
    return F.coalesce(text(2048).rlike(rules.FEED_ROOT) & text(65536).rlike(rules.FEED_BODY), F.lit(False))
