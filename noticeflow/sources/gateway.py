"""Where pages lead besides their links: redirects of gateway pages, sitemaps, config files.

All by expressions on a captured page's source; relative addresses are joined with its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.functions import text as T
from noticeflow.functions import urls as U

# How pages send their reader on, and the size of a page that only does so.
META_REFRESH = r"""(?i)<meta[^>]+http-equiv\s*=\s*["']?refresh["']?[^>]*content\s*=\s*["']?[^"'>;]*;\s*url\s*=\s*([^"'>\s]+)"""
SCRIPT_LOCATION = r"""(?i)(?:(?:top\.|self\.|window\.)?location(?:\.href)?\s*=|location\.replace\s*\()\s*["']([^"']+)["']"""
FRAME_SOURCE = r"""(?i)<frame[^>]+src\s*=\s*["']([^"']+)["']"""
MOVED_LINK = r"""(?i)href\s*=\s*["']([^"']+)["']"""
LARGEST_GATEWAY, MOST_TARGETS = 4096, 3
CONFIG_PATH = r"""(?i)["'](/[\w\-./]*/)["']\s*\+\s*(?:window\.)?(?:location\.)?host(?:name)?\s*\+\s*["']([\w.\-]*\.json)["']"""
LOCATION_TAG = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"


def join(base: Column, ref: Column) -> Column:
    """An address as a page at ``base`` means it: absolute, of its scheme, of its site, a
    query, or next to it; single dots and what two dots take back are resolved."""
    ref = F.trim(ref)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.regexp_replace(F.when(bare == site, F.concat(site, F.lit("/"))).otherwise(bare), r"[^/]*$", "")
    whole = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(site, ref))
        .when(ref.startswith("?"), F.concat(bare, ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .when(ref == "", base)
        .otherwise(F.concat(folder, ref))
    )
    head, path = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0), T.path(whole)
    rest = F.substr(whole, F.length(head) + F.length(path) + 1)
    parts = F.filter(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda p: p != ".")
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    folded = F.array_join(stack, "/")
    tail = F.when(path.rlike(r"/\.\.?$") & (folded != ""), "/").otherwise("")
    resolved = F.concat(head, F.lit("/"), folded, tail, rest)
    return F.when(whole.rlike(r"^[A-Za-z]+://") & path.rlike(r"(?:^|/)\.\.?(?:/|$)"), resolved).otherwise(whole)


def _all(html: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: x != "")


def targets(pages: DataFrame) -> DataFrame:
    """(page_id, place, url): where small gateway pages send their reader, three at most."""
    html = F.coalesce("html", F.lit(""))
    moved = F.when(F.lower(html).contains("object moved"), _all(html, MOVED_LINK)).otherwise(F.array().cast("array<string>"))
    raw = F.concat(_all(html, META_REFRESH), _all(html, SCRIPT_LOCATION), _all(html, FRAME_SOURCE), moved)
    small = pages.where(F.octet_length("html") <= LARGEST_GATEWAY).select("page_id", "url", F.array_distinct(F.transform(raw, lambda r: join(F.col("url"), r))).alias("to"))
    asset = "|".join(f"\\{t}" for t in rules.ASSET_TAILS)
    kept = F.filter("to", lambda u: u.rlike(r"(?i)^https?://") & (u != F.col("url")) & ~F.lower(T.path(u)).rlike(f"(?:{asset})$"))
    return small.select("page_id", F.posexplode(F.slice(kept, 1, MOST_TARGETS)).alias("place", "url"))


def sitemap(pages: DataFrame) -> DataFrame:
    """(page_id, place, url, score) of the addresses of XML sitemaps, likely boards first.

    An index names other sitemaps; its rows are addresses like all others.
    """
    each = pages.select("page_id", F.explode(F.array_distinct(_all(F.coalesce("html", F.lit("")), LOCATION_TAG))).alias("url"))
    scored = each.withColumn("score", T.board_score(F.col("url"), F.lit("")))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "url"))).select("page_id", "place", "url", "score")


def config_urls(pages: DataFrame) -> DataFrame:
    """(page_id, url) of the config files that gateway scripts load by the host's name."""
    html, host = F.coalesce("html", F.lit("")), U.netloc(F.col("url"))
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(CONFIG_PATH), F.lit(1)).alias("a"), F.regexp_extract_all(html, F.lit(CONFIG_PATH), F.lit(2)).alias("b"))
    return pages.select("page_id", F.explode(F.array_distinct(F.transform(pairs, lambda p: join(F.col("url"), F.concat(p["a"], host, p["b"]))))).alias("url"))


def host_variants(home: Column) -> Column:
    """A home's site with and without www, its own spelling first; empty without a host."""
    whole = F.when(home.contains("://"), home).otherwise(F.concat(F.lit("https://"), home))
    scheme, host = F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), U.netloc(whole)
    other = F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(F.concat(F.lit("www."), host))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(scheme, host), F.concat(scheme, other)))


def probe_order(homes: DataFrame, families: DataFrame, budget: int = 40) -> DataFrame:
    """(home, place, family, url): each family's first path, then each one's second, ...

    ``families`` has fam_ord, family, path_ord and path; it is a small rule table.
    """
    base = homes.select("home", F.posexplode(host_variants(F.col("home"))).alias("variant", "site"))
    # A rule table: some dozens of rows.
    each = base.withColumn("_", F.lit(1)).join(F.broadcast(families.withColumn("_", F.lit(1))), "_").drop("_")
    order = Window.partitionBy("home").orderBy("path_ord", "fam_ord", "variant")
    return each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget).select("home", "place", "family", F.concat("site", "path").alias("url"))
