"""Posts of board lists, from the cells of captured pages, as expressions on arrays.

A row's title cell is, in this order: the longest page link; a script link, with the address
of a view button or a file of the row, else the list page and the title; the longest file
link; or, in dated rows with a view or download button, the longest plain text.  The date is
the first one after the title, else the nearest cell before it that is a date only.  A page's
posts are its table rows if at least two are dated, else its dated list items if there are
more of these.  Nothing here shuffles: a page is one row until its posts are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import labels as L
from noticeflow.functions import rules
from noticeflow.functions import text as T
from noticeflow.sources import boards as source

_POST = "struct<title:string,url:string,unit:string,published:date>"
_K2_POST = r"(?i)/bbs/([^/]+)/(\d+)/(\d+)/artclView\.do"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _longest(cells: Column, keep) -> Column:
    """The index from 0 of the longest cell that is kept, the first of equals; null if none is."""
    found = F.filter(F.transform(cells, lambda c, i: F.struct(keep(c).alias("ok"), F.length(c["text"]).alias("n"), (-i).alias("i"))), lambda x: x["ok"])
    return -F.array_max(F.transform(found, lambda x: F.struct(x["n"], x["i"])))["i"]


def _first_url(cells: Column, keep) -> Column:
    return F.coalesce(F.get(F.filter(cells, keep), F.lit(0))["url"], F.lit(""))


def _judged(cells: Column, base: Column) -> Column:
    """Cells with what each can be."""
    listing = F.regexp_replace(base, "#.*$", "")

    def of(c: Column) -> Column:
        text, href, url = c["text"], F.trim(c["href"]), c["url"]
        return F.struct(
            text.alias("text"),
            c["plain"].alias("plain"),
            url.alias("url"),
            (href == "").alias("bare"),
            L.is_date_only(text).alias("day"),
            L.is_junk_title(text).alias("junk"),
            url.rlike(rules.FILE_LINK).alias("file"),
            F.lower(href).rlike("^(?:#|javascript)").alias("script"),
            ((url != "") & (F.regexp_replace(url, "#.*$", "") != listing) & L.is_button(text)).alias("button"),
            text.rlike(rules.VIEW_WORD).alias("view"),
        )

    return F.transform(cells, of)


def _without_echo(title: Column, after: Column) -> Column:
    """A title without a tail that the next cells say again, if that holds a date."""
    said = F.filter(F.transform(after, lambda c: T.squeeze(c["text"])), lambda t: t != "")
    follow = F.transform(F.slice(said, 1, 6), lambda t: F.struct(t.alias("t"), T.coerce_date(t).isNotNull().alias("dated")))
    ranges = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e - s).alias("n")) for s in range(1, 7) for e in range(7, s, -1)))

    def tail(words: Column) -> Column:
        fits = F.filter(ranges, lambda r: r["s"] + r["n"] - 1 <= F.size(words))
        cut = lambda r: F.slice(words, r["s"], r["n"])
        text = lambda r: F.array_join(F.transform(cut(r), lambda w: w["t"]), " ")
        ends = F.filter(fits, lambda r: F.exists(cut(r), lambda w: w["dated"]) & title.endswith(F.concat(F.lit(" "), text(r))) & (F.length(title) - F.length(text(r)) > rules.LEAST_TITLE))
        return F.coalesce(F.get(F.transform(ends, text), F.lit(0)), F.lit(""))

    cut_off = lambda t: F.when(t != "", F.rtrim(F.substring(title, F.lit(1), F.length(title) - F.length(t)))).otherwise(title)
    return _let(follow, lambda words: F.when(F.exists(words, lambda w: w["dated"]), _let(tail(words), cut_off)).otherwise(title))


def _post(cells: Column, base: Column) -> Column:
    """The post of a row of judged cells; null if it is none."""
    open_ = lambda c: ~c["bare"] & (F.trim(c["text"]) != "") & ~c["day"]
    link = lambda c: open_(c) & ~c["junk"]
    page = _longest(cells, lambda c: link(c) & (c["url"] != "") & ~c["file"] & (F.length(F.trim(c["text"])) >= rules.LEAST_TITLE))
    script = _longest(cells, lambda c: link(c) & (c["url"] == "") & c["script"])
    filed = _longest(cells, lambda c: link(c) & (c["url"] != "") & c["file"])
    view = _first_url(cells, lambda c: open_(c) & c["junk"] & c["button"] & c["view"])
    down = _first_url(cells, lambda c: open_(c) & c["junk"] & c["button"] & ~c["view"] & c["file"])
    plain = _longest(
        cells,
        lambda c: c["bare"]
        & F.length(c["text"]).between(rules.LEAST_TITLE, rules.LONGEST_PLAIN)
        & ~c["day"]
        & ~c["junk"]
        & ~c["text"].rlike(rules.NUMBER_CELL)
        & ~c["text"].rlike(rules.LABEL_CELL)
        & ~c["text"].rlike(rules.BYLINE_CELL),
    )
    text_at = lambda i: F.get(cells, i)["text"]
    url_at = lambda i: F.get(cells, i)["url"]
    nonempty = lambda c: F.nullif(c, F.lit(""))
    pick = lambda i, url, loose: F.struct(i.alias("i"), url.alias("url"), F.lit(loose).alias("loose"))

    def anchor(i: Column) -> Column:
        words = F.replace(F.replace(F.url_encode(F.substring(T.squeeze(text_at(i)), 1, 80)), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
        return F.concat(F.regexp_replace(base, "#.*$", ""), F.lit("#"), words)

    def choice(x: Column) -> Column:
        return (
            F.when(x["page"].isNotNull(), pick(x["page"], url_at(x["page"]), False))
            .when(F.length(F.trim(text_at(x["script"]))) >= rules.LEAST_TITLE, pick(x["script"], F.coalesce(nonempty(x["view"]), url_at(x["filed"]), anchor(x["script"])), False))
            .when(x["filed"].isNotNull(), pick(x["filed"], url_at(x["filed"]), False))
            .when(((x["view"] != "") | (x["down"] != "")) & x["plain"].isNotNull(), pick(x["plain"], F.coalesce(nonempty(x["view"]), x["down"]), True))
        )

    options = F.struct(page.alias("page"), script.alias("script"), filed.alias("filed"), view.alias("view"), down.alias("down"), plain.alias("plain"))

    def made(p: Column) -> Column:
        after = F.slice(cells, p["i"] + 2, F.greatest(F.size(cells) - p["i"] - 1, F.lit(0)))
        before = F.reverse(F.slice(cells, F.lit(1), p["i"]))
        later = F.filter(F.transform(after, lambda c: T.coerce_date(c["text"])), lambda d: d.isNotNull())
        earlier = F.filter(F.transform(F.filter(before, lambda c: c["day"]), lambda c: T.coerce_date(c["text"])), lambda d: d.isNotNull())
        day = F.coalesce(F.get(later, F.lit(0)), F.get(earlier, F.lit(0)))
        # Echoes are looked for before references are undone, as the cells say them again raw.
        plain_text = F.get(cells, p["i"])["plain"]
        name = F.when(plain_text == text_at(p["i"]), _let(T.squeeze(text_at(p["i"])), lambda title: _without_echo(title, after))).otherwise(plain_text)
        post = _let(_let(name, L.clean_title), lambda t: F.struct(t["title"].alias("title"), p["url"].alias("url"), t["unit"].alias("unit"), day.alias("published")))
        return _let(post, lambda x: F.when((F.length(x["title"]) >= rules.LEAST_TITLE) & ~(p["loose"] & x["published"].isNull()), x))

    return _let(options, lambda x: _let(choice(x), lambda p: F.when(p.isNotNull(), made(p))))


def _posts(rows: Column, base: Column) -> Column:
    """The posts of rows, the first of each address."""
    found = F.transform(rows, lambda cells: _let(_judged(cells, base), lambda judged: _post(judged, base)))
    there = F.filter(found, lambda p: p.isNotNull())
    return _let(there, lambda all_: _let(F.transform(all_, lambda p: p["url"]), lambda urls: F.filter(all_, lambda p, i: F.array_position(urls, p["url"]) == i + 1)))


def _dated(posts: Column) -> Column:
    return F.size(F.filter(posts, lambda p: p["published"].isNotNull()))


def lists(pages: DataFrame) -> DataFrame:
    """(page_id, label, posts) of captured pages (page_id, url, html).

    ``label`` is what the page calls its board; empty if it does not say.
    """
    read = source.read(pages)
    base = F.col("base")
    both = read.select("page_id", L.page_label(F.col("heads")).alias("label"), _posts(F.col("tables"), base).alias("_t"), _posts(F.col("items"), base).alias("_i"))
    items = F.filter("_i", lambda p: p["published"].isNotNull())
    table = F.filter("_t", lambda p: p["published"].isNotNull() | ~p["url"].rlike(rules.FILE_LINK))
    posts = F.when(_dated(F.col("_t")) >= rules.LEAST_DATED, table).when(F.size(items) > _dated(F.col("_t")), items).otherwise(F.col("_t"))
    return both.select("page_id", "label", posts.alias("posts"))


def rows(pages: DataFrame) -> DataFrame:
    """(page_id, pos, title, url, unit, published) of the posts of captured pages."""
    return lists(pages).select("page_id", F.posexplode("posts").alias("pos", "p")).select("page_id", "pos", "p.*")


def k2web_rows(pages: DataFrame) -> DataFrame:
    """The posts of captured K2Web lists, known by the addresses of their posts."""
    is_post = lambda c: c["href"].rlike(_K2_POST) & (F.trim(c["text"]) != "")
    at = lambda cells: F.array_position(F.transform(cells, is_post), F.lit(True))

    def made(cells: Column) -> Column:
        def of(i: Column) -> Column:
            cell = F.element_at(cells, i.cast("int"))
            origin = F.regexp_extract(F.col("base"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
            url = F.when(F.lower(cell["href"]).startswith("javascript"), F.concat(origin, F.regexp_extract(cell["href"], _K2_POST, 0))).otherwise(cell["url"])
            after = F.slice(cells, i.cast("int") + 1, F.greatest(F.size(cells) - i.cast("int"), F.lit(0)))
            unit = F.filter(after, lambda c: (c["text"] != "") & (c["href"] == "") & ~c["text"].rlike(r"^\d+$") & ~c["text"].rlike(r"(?<![\p{L}\p{N}_])20\d{2}[.\-/]\d{1,2}[.\-/]\d{1,2}(?![\p{L}\p{N}_])") & (F.length(c["text"]) <= rules.LONGEST_UNIT))
            days = F.filter(F.transform(cells, lambda c: T.coerce_date(c["text"])), lambda d: d.isNotNull())
            return F.struct(cell["text"].alias("title"), url.alias("url"), F.coalesce(F.get(unit, F.lit(0))["text"], F.lit("")).alias("unit"), F.get(days, F.lit(0)).alias("published"))

        return _let(at(cells), of)

    read = source.read(pages)
    found = F.transform(F.filter("tables", lambda cells: at(cells) > 0), made)
    keys = F.transform(found, lambda p: F.regexp_extract(p["url"], _K2_POST, 0))
    posts = _let(found, lambda all_: _let(keys, lambda k: F.filter(all_, lambda p, i: F.array_position(k, F.regexp_extract(p["url"], _K2_POST, 0)) == i + 1)))
    return read.select("page_id", "base", F.posexplode(posts).alias("pos", "p")).select("page_id", "pos", "p.*")


def feed_index(pages: DataFrame) -> DataFrame:
    """(page_id, pos, name, url) of the feeds that a page's tables list."""
    is_feed = lambda c: c["url"].rlike(rules.FEED_URL)
    named = lambda cells: F.get(F.filter(cells, lambda c: (c["href"] == "") & (T.squeeze(c["text"]) != "")), F.lit(0))["text"]
    rows_ = F.filter("tables", lambda cells: F.exists(cells, is_feed))
    each = F.transform(rows_, lambda cells: F.struct(F.substring(T.squeeze(F.element_at(F.split(F.coalesce(named(cells), F.lit("")), ">"), -1)), 1, 40).alias("name"), F.get(F.filter(cells, is_feed), F.lit(0))["url"].alias("url")))
    return source.read(pages).select("page_id", F.posexplode(each).alias("pos", "p")).select("page_id", "pos", "p.name", "p.url")
