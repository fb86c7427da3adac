"""Registries of sources: JSON files to one typed table, and the organisations in them.

A source is kept if its kind is known, it has a name, and it has what its kind needs: an
address; for K2Web boards their host, site and number; for organisations routes, a feed code
or a home page.  The files' order is the sources' order.  Rows of any number stay a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeflow.functions import rules
from noticeflow.functions import text as T
from noticeflow.functions import urls as U

RAW = (
    "id string, name string, kind string, url string, rights string, category string, enabled boolean, topics array<string>, org string, site string, "
    "host string, site_id string, board_id string, menu_no string, row string, api_url string, api_paths map<string,string>, routes array<array<string>>, "
    "korea_feed string, home string, `group` string, region string"
)
TEXTS = ("url", "category", "org", "site", "host", "site_id", "api_url", "korea_feed", "home", "group", "region")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Sources of JSON files: a list, or an object whose ``sources`` is one."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    listed = F.from_json("value", f"array<struct<{_fields()}>>")
    items = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.from_json("value", f"struct<sources:array<struct<{_fields()}>>>")["sources"])
    each = text.select("file", F.posexplode(items).alias("item", "s")).where("s is not null").select("file", "item", "s.*")
    return typed(each.withColumn("src_idx", F.row_number().over(Window.orderBy("file", "item")) - 1).drop("file", "item"))


def _fields() -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (f.split(" ", 1) for f in RAW.split(", ")))


def typed(raw: DataFrame) -> DataFrame:
    """Valid sources of raw ones (src_idx and the columns of RAW), with defaults filled in."""
    blank = lambda c: F.coalesce(F.trim(F.col(f"`{c}`")), F.lit(""))
    rows = raw.withColumn("name", blank("name")).withColumn("kind", F.lower(F.coalesce(F.nullif(blank("kind"), F.lit("")), F.lit("rss"))))
    for c in TEXTS:
        rows = rows.withColumn(c, blank(c))
    routes = F.filter(F.coalesce("routes", F.array()), lambda r: (F.size(r) >= 3) & ~F.exists(F.slice(r, 1, 3), lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""))
    route = lambda r: F.struct(F.trim(r[0]).alias("category"), F.trim(r[1]).alias("kind"), F.trim(r[2]).alias("url"))
    whole = lambda c: F.expr(f"try_cast({c} as int)")
    rows = (
        rows.withColumn("routes", F.transform(routes, route))
        .withColumn("rights", T.tier(F.col("rights")))
        .withColumn("enabled", F.coalesce("enabled", F.lit(True)))
        .withColumn("topics", F.filter(F.transform(F.coalesce("topics", F.array()), lambda t: F.trim(t)), lambda t: t != ""))
        .withColumn("id", F.coalesce(F.nullif(blank("id"), F.lit("")), F.concat(F.lit("src-"), F.col("src_idx").cast("string"))))
        .withColumn("board_id", whole("board_id"))
        .withColumn("menu_no", whole("menu_no"))
        .withColumn("row", F.coalesce(F.nullif(whole("row"), F.lit(0)), F.lit(50)))
        .withColumn("api_paths", F.map_filter(F.coalesce("api_paths", F.create_map().cast("map<string,string>")), lambda k, v: (F.trim(k) != "") & (F.trim(v) != "")))
    )
    enough = (
        F.when(F.col("kind") == "govorg", (F.size("routes") > 0) | (F.col("korea_feed") != "") | (F.col("home") != ""))
        .when(F.col("kind") == "k2web", (F.col("host") != "") & (F.col("site_id") != "") & F.col("board_id").isNotNull())
        .otherwise(F.col("url") != "")
    )
    return rows.where(F.col("kind").isin(*rules.SOURCE_KINDS) & (F.col("name") != "") & enough)


def enabled(sources: DataFrame) -> DataFrame:
    return sources.where("enabled")


def categories(sources: DataFrame) -> Column:
    """The categories of a source, in order, press releases last if only a feed gives them."""
    own = F.transform("routes", lambda r: r["category"])
    return F.array_distinct(F.when(F.col("korea_feed") != "", F.concat(own, F.array(F.lit(rules.KOREA_CATEGORY)))).otherwise(own))


def _stage_rows(routes: Column, category: Column) -> Column:
    """Stages of one category: feeds, boards, other addresses of each, open data."""
    pair = lambda stage, url: F.struct(F.lit(stage).alias("stage"), url.alias("url"))
    own = F.filter(routes, lambda r: r["category"] == category)
    of = lambda kind: F.transform(F.filter(own, lambda r: r["kind"] == kind), lambda r: pair(kind, r["url"]))
    other = F.flatten(F.transform(own, lambda r: F.transform(U.alternates(r["url"]), lambda u: pair("alt", u))))
    return F.concat(of("rss"), of("board"), other, of("datago"))


def stages(sources: DataFrame) -> DataFrame:
    """(src_idx, cat_ord, category, stage_ord, stage, url): what would be tried, in order.

    Organisations by category, K2Web boards by their coordinates, others by their address.
    """
    korea = F.array(F.struct(F.lit("korea").alias("stage"), F.format_string(rules.KOREA_FEED, "korea_feed").alias("url")))
    names = sources.where("kind = 'govorg'").select("src_idx", "routes", "korea_feed", F.posexplode(categories(sources)).alias("cat_ord", "category"))
    planned = _stage_rows(F.col("routes"), F.col("category"))
    press = (F.col("category") == rules.KOREA_CATEGORY) & (F.col("korea_feed") != "")
    orgs = names.select("src_idx", "cat_ord", "category", F.when(press, F.concat(planned, korea)).otherwise(planned).alias("s"))
    k2 = U.k2web(F.col("host"), F.col("site_id"), F.col("board_id"), F.col("menu_no"), F.col("row"), F.col("api_url"))
    one = F.array(F.struct(F.col("kind").alias("stage"), F.col("url").alias("url")))
    rest = sources.where("kind <> 'govorg'").select("src_idx", F.lit(0).alias("cat_ord"), "category", F.when(F.col("kind") == "k2web", k2).otherwise(one).alias("s"))
    return orgs.unionByName(rest).select("src_idx", "cat_ord", "category", F.posexplode("s").alias("stage_ord", "p")).select("src_idx", "cat_ord", "category", "stage_ord", "p.stage", "p.url")


def notices(rows: DataFrame, sources: DataFrame, stage: Column | None = None) -> DataFrame:
    """Notices of parsed rows (src_idx, item_idx, title, url, published, unit, from_url).

    A row takes name, licence, category and place from its source; addresses that are not
    absolute are those of the source's site; rows without title or address go.
    """
    s = sources.select("src_idx", F.col("name").alias("agency"), "category", "rights", "topics", "org", "site", "kind")
    site = F.regexp_extract("from_url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    url = F.when(F.col("url").startswith("/") & ~F.col("url").startswith("//"), F.concat(site, "url")).otherwise(F.col("url"))
    both = rows.where("title <> '' and url <> ''").join(s, "src_idx").withColumn("url", url)
    return (
        both.withColumn("unit", F.coalesce(F.nullif("unit", F.lit("")), F.nullif("site", F.lit("")), "agency"))
        .withColumn("site", F.coalesce(F.nullif("site", F.lit("")), F.when(F.col("kind") == "govorg", F.col("agency")).otherwise("")))
        .withColumn("origin", U.origin_label(F.col("from_url"), F.col("kind") if stage is None else stage))
        .drop("from_url", "kind")
    )


def _first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    names = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in names)), F.struct(*order)).alias("_r"))
    return got.select(*keys, *(F.col(f"_r.`{c}`").alias(c) for c in names))


def catalog(sections: DataFrame, cache: DataFrame) -> DataFrame:
    """Organisations with a home page, the first of each id, and whether routes are cached.

    ``sections`` are typed sources with ``section``; ``cache`` has id and routes.
    """
    own = _first_by(sections.where("kind = 'govorg' and home <> ''").select("id", F.coalesce(F.nullif("org", F.lit("")), "name").alias("name"), "section", "group", "region", "home", "src_idx"), ["id"], ["src_idx"])
    known = cache.where(F.size("routes") > 0).select("id", F.lit(True).alias("_known")).distinct()
    return own.join(known, "id", "left").withColumn("checked", F.coalesce("_known", F.lit(False))).drop("_known")


def org_index(sources: DataFrame) -> DataFrame:
    """(org, group, n): organisations with how many different sources each has."""
    name = F.coalesce(F.nullif("org", F.lit("")), "name")
    key = F.when(~F.col("id").startswith("src-"), F.col("id")).otherwise(F.concat_ws(":", "kind", F.coalesce(F.nullif("url", F.lit("")), "home")))
    return sources.groupBy(name.alias("org")).agg(F.count_distinct(key).alias("n"), F.min("src_idx").alias("first"))


def media_hosts(urls: DataFrame) -> DataFrame:
    """Distinct hosts of addresses (url), without www; numbers and single names left out."""
    host = T.bare_host(T.host(F.col("url")))
    return urls.select(host.alias("host")).where(F.col("host").contains(".") & ~F.col("host").rlike(r"^[0-9.]+$")).distinct()
