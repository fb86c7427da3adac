"""Rows of captured board lists: one HTML pass on the executors gives cells, no verdicts.

A page becomes its table rows and its list items, each an array of cells (text, plain, href,
url), and the texts of its title and headings.  ``plain`` has character references undone
that were escaped twice; ``url`` is the absolute address of a cell's link, read off a script
if it stands there as a string; empty if there is none.  What is a post is decided by SQL
expressions (``noticeflow.operators.boards``).

Bytes are UTF-8, else cp949, else UTF-8 with replacements.  Null pages have no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import rules

CELL = "struct<text:string,plain:string,href:string,url:string>"
SCHEMA = f"page_id long, base string, tables array<array<{CELL}>>, items array<array<{CELL}>>, heads array<string>"
_VOID = frozenset(("br", "img", "hr", "input", "wbr", "meta", "link", "source", "col"))
_QUIET = frozenset(("script", "style", "template", "noscript"))
_IS_FILE = re.compile(rules.FILE_LINK).search
_ENTITY, _BROKEN, _LITERAL = re.compile(rules.ENTITY), re.compile(rules.BROKEN_ENTITY_TAIL), re.compile(rules.SCRIPT_URL)
_DATED = re.compile(r"(?<![^\W])20\d{2}[.\-/]\d{1,2}[.\-/]\d{1,2}(?!\w)|20\d{2}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일|(?<!\d)20\d{6}(?!\d)|(?<![\d.])\d{2}[.\-/]\d{1,2}[.\-/]\d{1,2}(?![\d.])")

Event = tuple[str, str, dict[str, str]]


def decode(data: bytes | str | None) -> str:
    """Text of a page: the first of UTF-8 and cp949 that reads it whole, else what UTF-8 can."""
    if data is None or isinstance(data, str):
        return data or ""
    for name in ("utf-8", "cp949"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


class _Reader(HTMLParser):
    """A page as a list of events: open and close with a tag, text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self.events.append(("close", tag, {}))

    def handle_data(self, data):
        self.events.append(("text", data, {}))


def events_of(html: str) -> list[Event]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.events


def _without_glyphs(events: Iterable[Event], fresh: frozenset[str], ends: frozenset[str]) -> Iterator[Event]:
    """Events less the text in icon fonts; an icon left open ends with its cell at the latest."""
    inside: list[str] = []
    for kind, value, attrs in events:
        if kind == "text":
            if inside:
                continue
        elif kind == "open":
            if value in fresh:
                inside = []
            if value not in _VOID and any(g in attrs.get("class", "").lower() for g in rules.GLYPH_CLASSES):
                inside.append(value)
        elif inside and inside[-1] == value:
            inside.pop()
        elif value in ends:
            inside = []
        yield kind, value, attrs


def target(attrs: dict[str, str]) -> str:
    """Where an anchor goes; a script if its address is only there."""
    href, script = attrs.get("href", "").strip(), attrs.get("onclick", "").strip()
    dead = not href or href[0] == "#" or href.lower().startswith("javascript")
    return f"javascript:{script}" if script and dead else href


def _cell(parts: list[tuple[str, int]], links: list[str]) -> list[tuple[str, str]]:
    """Cells of one table cell: its text up to the end of its longest page link, and the rest
    if that holds a date.  ``parts`` are texts with the number of their link, or -1."""
    text = "".join(t for t, _ in parts)
    spans: dict[int, list[int]] = {}
    at = 0
    for t, link in parts:
        if link >= 0:
            spans.setdefault(link, [at, at])[1] = at + len(t)
        at += len(t)
    pages = [(len(text[b:e].strip()), -k, e) for k, (b, e) in spans.items() if text[b:e].strip() and not _IS_FILE(links[k])]
    first = next((x for x in links if x), "")
    if not pages:
        return [(" ".join(text.split()), first)]
    _, k, end = max(pages)
    out = [(" ".join(text[:end].split()), links[-k] or first)]
    rest = " ".join(text[end:].split())
    return [*out, (rest, "")] if _DATED.search(rest) else out


def table_rows(events: list[Event]) -> list[list[tuple[str, str]]]:
    rows: list[list[tuple[str, str]]] = []
    row, parts, links, link = None, None, [], -1
    edges = frozenset(("tr", "td", "th"))
    for kind, value, attrs in _without_glyphs(events, edges, edges | {"a"}):
        if kind == "text":
            if parts is not None:
                parts.append((value, link))
        elif value in ("td", "th"):
            if kind == "open" and row is not None:
                parts, links, link = [], [], -1
            elif kind == "close" and parts is not None:
                row += _cell(parts, links)
                parts = None
        elif value == "tr":
            if kind == "close" and row:
                rows.append(row)
            row = [] if kind == "open" else None
            parts = None
        elif value == "a" and parts is not None:
            link = -1
            if kind == "open":
                links.append(target(attrs))
                link = len(links) - 1
    return rows


def item_rows(events: list[Event]) -> list[list[tuple[str, str]]]:
    """List items, inner before outer: each text between two tags is a cell."""
    quiet, shown = 0, []
    for e in events:
        if e[0] != "text" and e[1] in _QUIET:
            quiet = quiet + 1 if e[0] == "open" else max(0, quiet - 1)
        elif not quiet:
            shown.append(e)
    rows, nest, hrefs, text = [], [], [], []
    for kind, value, attrs in _without_glyphs(shown, frozenset(("li",)), frozenset(("li", "a"))):
        if kind == "text":
            text.append(value)
            continue
        if kind == "close" and value in _VOID:
            continue
        said, text = " ".join("".join(text).split()), []
        if said and nest:
            nest[-1].append((said, hrefs[-1] if hrefs else ""))
        if value == "li":
            if kind == "open":
                nest.append([])
            elif nest and (row := nest.pop()):
                rows.append(row)
        elif value == "a":
            if kind == "open":
                hrefs.append(target(attrs))
            elif hrefs:
                hrefs.pop()
    return rows


def heads(events: list[Event], most: int = 12) -> list[str]:
    """The title, then the first headings; navigation and footers left out."""
    title, found, quiet, open_, text = "", [], 0, "", []
    for kind, value, _ in events:
        if kind == "text":
            text.append(value)
        elif value in _QUIET or value in ("nav", "footer"):
            quiet = quiet + 1 if kind == "open" else max(0, quiet - 1)
        elif kind == "open" and not open_ and not quiet and value in ("title", "h1", "h2", "h3"):
            open_, text = value, []
        elif kind == "close" and value == open_:
            said, open_ = " ".join("".join(text).split()), ""
            if value == "title":
                title = title or said
            elif said and len(found) < most:
                found.append(said)
    return [title, *found]


def _plain(text: str) -> str:
    if "&" not in text:
        return text
    out = _ENTITY.sub(lambda m: unescape(m[0]), text)
    cut = _BROKEN.search(out)
    known = cut and any(n.startswith(cut[0][1:].lower()) for n in rules.ENTITY_NAMES)
    return out[: cut.start()].rstrip() if known else out


def absolute(href: str, base: str) -> str:
    """The http address that a link opens; empty for the page itself and for plain scripts."""
    options = [href]
    if href.lower().startswith("javascript"):
        found = (m[1] for m in _LITERAL.finditer(href))
        options = [p for p in found if "?" in p or "." in p.split("?", 1)[0].rsplit("/", 1)[-1]]
    elif not href or href.startswith("#"):
        return ""
    for option in options:
        try:
            url = urljoin(base, option)
            if urlsplit(url).scheme in ("http", "https"):
                return url
        except ValueError:
            continue
    return ""


def _typed(rows: list[list[tuple[str, str]]], base: str) -> list[list[dict[str, str]]]:
    return [[{"text": t, "plain": _plain(t), "href": h, "url": absolute(h.strip(), base)} for t, h in row] for row in rows]


def read(pages: DataFrame) -> DataFrame:
    """SCHEMA rows of captured pages (page_id, url, html: text or bytes)."""
    cell = pa.struct([(n, pa.string()) for n in ("text", "plain", "href", "url")])
    rows = pa.list_(pa.list_(cell))
    kinds = pa.schema([("page_id", pa.int64()), ("base", pa.string()), ("tables", rows), ("items", rows), ("heads", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A page at a time, so that memory holds the cells of one.
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                events, base = events_of(decode(html)), url or ""
                row = {"page_id": key, "base": base, "tables": _typed(table_rows(events), base), "items": _typed(item_rows(events), base), "heads": heads(events)}
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, SCHEMA)
