"""All queries over notices, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions import files, labels, rules, urls
from noticeflow.functions import text as T
from noticeflow.operators import boards, collect, digest, greedy, insight, relevance, routes
from noticeflow.plans import oracle, views
from noticeflow.sources import feeds, gateway, pages, registry, robots

NOW, DAYS = oracle.NOW, oracle.DAYS
QUERIES: dict = {}
ORACLE_SQL: dict = dict(oracle.SQL)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _current(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The notices of the period, first of each link: all columns, or those named."""
    return collect.first_wins(collect.since(views.notices(spark, d), NOW, DAYS), columns=columns or None)


def _seen(n: DataFrame) -> DataFrame:
    """A state: the keys of two thirds of the notices."""
    key = T.dedup_key(F.col("url"), F.col("agency"), F.col("title"))
    return n.where(F.col("item_idx") % 3 != 0).groupBy(key.alias("key")).agg(F.min("item_idx").alias("pos"))


def _array_text(c: str) -> F.Column:
    return F.array_join(c, "|").alias(c)


@query
def digest_agencies(spark, d):
    return digest.agencies(_current(spark, d, "agency")).select("agency", "n")


@query
def digest_categories(spark, d):
    return digest.categories(_current(spark, d, "category")).select("category", "n")


@query
def digest_etc(spark, d):
    return digest.other_labels(_current(spark, d, "category")).select("label", "n")


@query
def digest_totals(spark, d):
    return digest.totals(_current(spark, d, "agency", "category"), 5, 5)


@query
def digest_keywords(spark, d):
    return digest.keywords(_current(spark, d, "agency", "title"))


@query
def tokens_title(spark, d):
    n = views.notices(spark, d)
    return n.select("item_idx", F.array_join(F.array_sort(T.title_tokens(F.col("title"))), " ").alias("tokens"))


@query
def tokens_strip_suffix(spark, d):
    """Each word of the titles, with a suffix that its place gives it."""
    n = views.notices(spark, d).select("item_idx", F.posexplode(T.words(F.col("title"))).alias("pos", "bare"))
    suffix = F.element_at(F.array(*map(F.lit, rules.SUFFIXES)), (F.pmod(F.col("item_idx") + F.col("pos"), F.lit(len(rules.SUFFIXES))) + 1).cast("int"))
    word = n.withColumn("word", F.concat("bare", F.when(F.col("pos") % 3 == 0, "").otherwise(suffix)))
    return word.select("item_idx", "pos", "word", T.strip_suffix(F.col("word")).alias("stem"))


def _mixed(key: str, *lists) -> F.Column:
    """Texts put together of one entry of each list, all combinations in turn."""
    parts, step = [], 1
    for values in lists:
        parts.append(F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col(key) / step) % len(values) + 1).cast("int")))
        step *= len(values)
    return F.concat(*parts)


@query
def date_parse(spark, d):
    n = views.notices(spark, d).select("item_idx", _mixed("item_idx", oracle.DATES, oracle.DATE_HEADS, oracle.DATE_TAILS).alias("raw"))
    return n.select("item_idx", "raw", T.parse_date(F.col("raw")).alias("day"))


@query
def label_tidy(spark, d):
    n = views.notices(spark, d).select("item_idx", _mixed("item_idx", oracle.LABEL_CORES, oracle.LABEL_HEADS, oracle.LABEL_TAILS).alias("raw"))
    return n.select("item_idx", "raw", labels.tidy_label(F.col("raw")).alias("label"), labels.slot_of(F.col("raw")).alias("slot"))


@query
def title_clean(spark, d):
    n = views.notices(spark, d).select("item_idx", F.concat(F.element_at(F.array(*map(F.lit, oracle.TITLE_HEADS)), (F.col("item_idx") % len(oracle.TITLE_HEADS) + 1).cast("int")), F.regexp_extract("title", "^[A-Za-z]*", 0), F.lit(" 안내문 "), F.element_at(F.array(*map(F.lit, oracle.TITLE_TAILS)), (F.floor(F.col("item_idx") / 7) % len(oracle.TITLE_TAILS) + 1).cast("int"))).alias("raw"))
    return n.select("item_idx", "raw", labels.clean_title(F.col("raw")).alias("t"), labels.is_junk_title(F.col("raw")).alias("junk")).select("item_idx", "raw", "t.title", "t.unit", "junk")


@query
def category_classify(spark, d):
    n = views.notices(spark, d)
    return n.select("item_idx", T.classify(F.col("category")).alias("found"), T.canonical(F.col("category")).alias("name"), T.notice_category(F.col("category"), F.concat(F.col("category"), F.lit(" "), F.col("title"))).alias("notice_category"))


@query
def rights_gate(spark, d):
    n = views.notices(spark, d)
    return n.select("item_idx", T.tier(F.col("rights")).alias("tier"), T.badge(F.col("rights")).alias("badge"), T.allows_derivative(F.col("rights")).alias("derivative"))


@query
def text_clean(spark, d):
    return views.notices(spark, d).select("item_idx", "summary")


@query
def collect_report(spark, d):
    n = collect.collected(views.notices(spark, d), now=NOW, days=DAYS)
    return collect.ranked(n, 50).select("rank", "item_idx", "agency", "published", "title", "summary")


@query
def collect_agency_filter(spark, d):
    n = collect.collected(views.notices(spark, d), now=NOW, days=DAYS, agency="src1", mode="full")
    return n.select("item_idx", "agency", "published", "summary")


@query
def collect_dedup(spark, d):
    return collect.first_wins(views.notices(spark, d)).select("src_idx", "item_idx", "url")


@query
def collect_inherit(spark, d):
    n = views.notices(spark, d)
    s = n.groupBy("src_idx").agg(F.min("agency").alias("name")).select(
        "src_idx", "name", F.concat(F.lit("O"), "src_idx").alias("org"), F.when(F.col("src_idx") % 2 == 0, F.concat(F.lit("S"), "src_idx")).otherwise("").alias("site"), F.array(F.lit("행사")).alias("topics")
    )
    bare = n.withColumn("unit", F.lit("")).withColumn("org", F.when(F.col("item_idx") % 5 == 0, F.col("org")).otherwise(""))
    return collect.inherit(bare, s).select("item_idx", "unit", "org", "site", _array_text("topics"))


@query
def state_mark_new(spark, d):
    n = _current(spark, d, "url", "agency", "title")
    return collect.mark_new(n, _seen(views.notices(spark, d))).select("item_idx", "is_new")


@query
def state_only_new(spark, d):
    n = _current(spark, d, "url", "agency", "title")
    return collect.mark_new(n, _seen(views.notices(spark, d))).where("is_new").select("item_idx", "url")


@query
def state_merge(spark, d):
    n = _current(spark, d, "url", "agency", "title")
    now = n.where(F.col("agency") == "src3").select(T.dedup_key(F.col("url"), F.col("agency"), F.col("title")).alias("key"))
    return collect.merge_state(now, _seen(views.notices(spark, d)))


@query
def group_by_agency(spark, d):
    n = _current(spark, d, "agency", "published")
    return n.groupBy("agency").agg(F.count(F.lit(1)).alias("n"), F.max("published").alias("latest"), F.count("published").alias("dated"))


@query
def group_by_topic(spark, d):
    return digest.topics(_current(spark, d, "topics")).select("pos", "topic", "n")


@query
def group_by_org(spark, d):
    return digest.organisations(_current(spark, d, "org", "site", "agency")).select("pos", "org", "site", "n", "org_n")


@query
def orders_by_region(spark, d):
    return digest.organisations(views.order_notices(spark, d).withColumn("site", F.col("agency"))).select("pos", "org", "site", "n", "org_n")


@query
def weekly_counts(spark, d):
    return digest.weekly(views.event_notices(spark, d))


@query
def weekly_trend(spark, d):
    return digest.trend(digest.weekly(views.order_notices(spark, d), 40))


@query
def agency_activity(spark, d):
    return digest.activity(views.order_notices(spark, d))


@query
def new_keywords(spark, d):
    n = collect.mark_new(_current(spark, d, "url", "agency", "title"), _seen(views.notices(spark, d)))
    return digest.new_keywords(n)


def _theme() -> relevance.Theme:
    return relevance.Theme("english", (("first", {"the": ("with",), "and": ()}), ("second", {"tion": ("ing",), "장학": ("학자금",)}), ("third", {"채용": ("모집",), "복지": ()})))


@query
def relevance_scores(spark, d):
    m = relevance.score(_current(spark, d), _theme())
    return m.select("item_idx", "score", _array_text("matched"), "section")


@query
def relevance_sections(spark, d):
    m = relevance.select(_current(spark, d), _theme(), 6)
    return m.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query
def relevance_select(spark, d):
    m = relevance.select(_current(spark, d), _theme(), 6).orderBy(*relevance.order()).limit(40)
    return m.select("item_idx", "score", "section")


@query
def brief_keywords(spark, d):
    m = relevance.select(_current(spark, d), _theme(), 6)
    counts = m.select(F.explode("matched").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return digest.top(counts, "word", 6)


@query
def cluster_groups(spark, d):
    c = greedy.clusters(_current(spark, d))
    return c.select("src_idx", "item_idx", "leader_src", "leader_item")


@query
def insight_issues(spark, d):
    return insight.issues(greedy.clusters(_current(spark, d, "title", "published", "agency"))).select("pos", "title", "n", "agencies")


@query
def insight_timeline(spark, d):
    return insight.timeline(greedy.clusters(_current(spark, d, "title", "published", "agency")))


def _brief(spark, d) -> DataFrame:
    m = relevance.select(_current(spark, d), _theme(), 6)
    return greedy.clusters(m, within="section")


@query
def brief_issues(spark, d):
    return insight.brief(_brief(spark, d), _theme()).select("section_ord", "pos", "section", "title", "score", "n")


@query
def brief_totals(spark, d):
    n = collect.mark_new(_brief(spark, d), _seen(views.notices(spark, d)))
    return insight.brief_totals(n, _current(spark, d, "agency"))


@query
def report_agencies(spark, d):
    n = collect.mark_new(_current(spark, d, "url", "agency", "title"), _seen(views.notices(spark, d)))
    return insight.report_totals(n)


@query
def agency_rows(spark, d):
    return insight.agency_rows(_current(spark, d, "agency", "published", "title")).select("agency", "pos", "item_idx", "published", "title")


@query
def verify_groups(spark, d):
    return insight.verify_groups(_current(spark, d, "org", "category"))


def _web_kept(spark, d) -> DataFrame:
    n = views.notices(spark, d).select("src_idx", "item_idx", "title", "url", "agency", "published", "category", "org")
    own = lambda key: F.concat(F.col("org"), F.lit("|"), key)
    keys = F.array(own(T.dedup_key(F.col("url"), F.col("agency"), F.col("title"))), own(labels.title_key(F.col("title"), F.col("published"))))
    day = F.coalesce(F.date_diff(F.lit("9999-12-31").cast("date"), F.col("published")), F.lit(2**31 - 1))
    order = F.struct(F.col("org").alias("org"), day.alias("day"), (~T.canonical(F.col("category")).isin(*rules.SPECIFIC)).alias("vague"), F.col("src_idx").alias("src"), F.col("item_idx").alias("item"))
    return greedy.keep_first(n, keys, order)


@query
def web_dedup(spark, d):
    return _web_kept(spark, d).select("org", "item_idx")


@query
def web_contributing(spark, d):
    """Boards, forty documents each, of which a kept notice came."""
    board = F.expr("item_idx div 40").alias("route")
    every = views.notices(spark, d).select("src_idx", board).distinct()
    return routes.contributing(_web_kept(spark, d).select("src_idx", board), every)


@query
def url_keys(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    boards_ = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://K.kr/Bbs/site"), (F.col("page_id") % 5).cast("string"), F.lit("/7/"), F.when(F.col("page_id") % 2 == 0, "rssList.do?row=50").otherwise("artclList.do#x"))).otherwise(F.col("url"))
    return p.select("page_id", urls.board_key(boards_).alias("key"), urls.slug(F.col("url")).alias("slug"))


@query
def origin_tag(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    url = F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("mid=a"), F.col("page_id").cast("string"), F.lit("&sort=2&bbsId=7"))
    stage = F.element_at(F.array(*map(F.lit, ("rss", "board", "list", "other"))), (F.col("page_id") % 4 + 1).cast("int"))
    return p.select("page_id", urls.origin_label(url, stage).alias("origin"))


@query
def web_rows(spark, d):
    n = _current(spark, d)
    unit = F.when(F.col("site").isin("") | (F.col("site") == F.col("org")), "").otherwise(F.col("site"))
    return n.select("item_idx", "title", "url", F.date_format("published", "yyyy-MM-dd").alias("date"), digest.category_name().alias("group"), unit.alias("unit"))


def _attempts(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    stage = F.pmod(F.col("event_id"), F.lit(5)).cast("int")
    return e.select(
        F.expr("event_id div 15").cast("int").alias("src_idx"),
        F.element_at(F.array(*map(F.lit, ("보도자료", "공지", "채용"))), (F.expr("event_id div 5") % 3 + 1).cast("int")).alias("category"),
        stage.alias("stage_ord"),
        F.element_at(F.array(*map(F.lit, rules.STAGES)), stage + 1).alias("stage"),
        (F.col("user_id") % 4 != 0).alias("robots_ok"),
        (F.col("user_id") % 3 != 0).alias("fetched"),
        (F.col("user_id") % 5).cast("int").alias("n_rows"),
    )


@query
def cascade_first_success(spark, d):
    return routes.first_success(_attempts(spark, d))


@query
def cascade_trail(spark, d):
    return routes.trails(_attempts(spark, d))


@query
def plan_routes(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    rows = p.select(
        (F.col("page_id") % 7).alias("org_id"),
        (F.col("page_id") % 3).alias("group_ord"),
        F.col("page_id").alias("pos"),
        F.element_at(F.array(*map(F.lit, views.LABELS)), (F.col("page_id") % 12 + 1).cast("int")).alias("category"),
        "url",
    )
    return routes.plan(rows)


@query
def fair_order(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    rows = p.select((F.col("page_id") % 5).alias("home"), F.element_at(F.array(*map(F.lit, views.LABELS)), (F.col("page_id") % 12 + 1).cast("int")).alias("label"), "url")
    out = routes.fair_order(rows.withColumn("category", T.canonical(F.col("label"))))
    return out.select("home", "place", "category", "url", "score")


@query
def board_score(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    label = F.element_at(F.array(*map(F.lit, views.LABELS)), (F.col("page_id") % 12 + 1).cast("int"))
    return p.select("page_id", T.board_score(F.col("url"), label).cast("int").alias("score"))


@query
def dominant_category(spark, d):
    n = views.notices(spark, d)
    titles = n.select(F.col("org"), F.expr("item_idx div 40").alias("board"), F.when(F.col("item_idx") % 5 < 4, F.when(F.expr("item_idx div 40") % 2 == 0, "장학생 선발").otherwise("직원 채용")).otherwise(F.col("title")).alias("title"))
    return routes.dominant(titles, "board")


@query
def bake_upsert(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    cache = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 9).alias("count"), F.lit("2024-01-01").cast("date").alias("checked"))
    status = F.when(F.col("c_custkey") % 5 == 0, "timeout").when(F.col("c_custkey") % 7 == 0, "none").otherwise("ok")
    found = c.where("c_custkey % 2 <> 0 or c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 11).alias("count"), F.lit("2024-02-01").cast("date").alias("checked"), status.alias("status"))
    return routes.merge_cache(cache, found)


@query
def access_verdicts(spark, d):
    p = spark.read.parquet(f"{d}/lineitem.parquet")
    org = F.col("l_orderkey") % 500
    checks = p.where("l_linenumber > 1").select(org.alias("org"), F.when(F.col("l_orderkey") % 500 % 9 == 0, "korea").otherwise("rss").alias("label"), F.col("l_returnflag").alias("url"), ((F.col("l_suppkey") + F.col("l_orderkey") % 500) % 3 != 0).alias("allowed"))
    roots = p.where("l_linenumber = 1").select(org.alias("org"), (F.col("l_linestatus") == "O").alias("allowed"))
    return routes.access(checks, roots)


@query
def access_counts(spark, d):
    return routes.verdict_counts(access_verdicts(spark, d))


def _route_attempts(spark, d) -> DataFrame:
    route = F.when((F.col("category") == rules.KOREA_CATEGORY) & (F.col("stage") == "korea"), -1).otherwise(F.expr("stage_ord div 2"))
    return _attempts(spark, d).withColumn("route", route.cast("int"))


@query
def route_cascade(spark, d):
    return routes.by_route(_route_attempts(spark, d))


@query
def failure_groups(spark, d):
    return routes.failures(routes.by_route(_route_attempts(spark, d)))


@query
def failure_reasons(spark, d):
    return routes.failure_reasons(_attempts(spark, d))


def _sources(spark, d) -> DataFrame:
    """Suppliers as sources of all kinds."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("rss", "datago", "k2web", "govweb", "GovOrg", "ftp"))), (k % 6 + 1).cast("int"))
    home = F.concat(F.lit("https://www.s"), k.cast("string"), F.lit(".kr/"))
    route = lambda c, t, p: F.array(F.lit(c), F.lit(t), F.concat(home, F.lit(p)))
    some = F.when(k % 12 == 4, F.array(route("공지", "board", "kor/b"), route("보도자료", "rss", "press.xml"), route("공지", "rss", " n.xml "), route("채용", "datago", ""), route("공지", " ", "x")))
    text = lambda v: F.lit(v).cast("string")
    raw = spark.read.parquet(f"{d}/supplier.parquet").select(
        (k - 1).cast("int").alias("src_idx"), F.when(k % 7 != 0, F.concat(F.lit("id"), (k % 40).cast("string"))).alias("id"), F.when(k % 11 != 0, F.col("s_name")).otherwise(" ").alias("name"), kind.alias("kind"),
        F.when(k % 5 != 0, F.concat(home, F.lit("list.do"))).alias("url"), F.lit("KOGL_type1").alias("rights"), F.lit("정책").alias("category"), F.when(k % 3 != 0, k % 4 != 0).alias("enabled"),
        F.array(F.lit(" 복지 "), F.lit("")).alias("topics"), F.when(k % 2 == 0, F.concat(F.lit("기관"), (k % 9).cast("string"))).alias("org"), text("").alias("site"), F.concat(F.lit("h"), k.cast("string"), F.lit(".kr")).alias("host"),
        F.when(k % 4 != 0, F.lit("s")).alias("site_id"), F.when(k % 9 == 0, F.lit("x")).otherwise(k.cast("string")).alias("board_id"), F.when(k % 8 == 2, F.lit("5")).alias("menu_no"), text("").alias("row"), text("").alias("api_url"),
        F.create_map().cast("map<string,string>").alias("api_paths"), some.alias("routes"), F.when(k % 24 == 10, F.lit("dept")).alias("korea_feed"), F.when((k % 8 == 4) | (k % 12 == 10), home).alias("home"), (k % 3).cast("string").alias("group"), text("").alias("region"),
    )
    return registry.typed(raw)


@query
def source_registry(spark, d):
    return _sources(spark, d).select("src_idx", "id", "name", "kind", "rights", "enabled", _array_text("topics"), "board_id", "row", F.size("routes").alias("routes"))


@query
def source_enabled(spark, d):
    return registry.enabled(_sources(spark, d)).select("src_idx", "name")


@query
def stage_plan(spark, d):
    return registry.stages(_sources(spark, d))


@query
def catalog_checked(spark, d):
    s = _sources(spark, d).withColumn("section", F.when(F.col("src_idx") % 2 == 0, "정부").otherwise("학교"))
    cache = s.where("src_idx % 4 <> 1").select("id", "routes")
    return registry.catalog(s, cache).select("id", "name", "section", "home", "checked")


@query
def org_index(spark, d):
    return registry.org_index(_sources(spark, d))


@query
def media_hosts(spark, d):
    return registry.media_hosts(spark.read.parquet(f"{d}/pages.parquet"))


@query
def media_allowed(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    url = F.element_at(F.array(F.col("url"), F.lit("https://a.go.kr/x"), F.lit("http://10.0.0.1/x"), F.lit("ftp://b.ac.kr/")), (F.col("page_id") % 4 + 1).cast("int"))
    return p.select("page_id", urls.media_allowed(url, F.array(F.lit("example.org"), F.lit("korea.kr"))).alias("allowed"))


@query
def robots_allowed(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    origin = robots.origin(F.col("url"))
    rules_ = p.select(origin.alias("origin")).where("origin not like '%.org'").distinct().select("origin", F.lit("User-agent: *\nDisallow: /en/\nCrawl-delay: 4").alias("text"))
    return robots.checked(p.select("url").distinct(), rules_).select("url", "allowed", F.coalesce("delay", F.lit(0.0)).cast("int").alias("delay"))


@query
def board_rows(spark, d):
    """Documents as rows of board tables and lists, fifty to a page, read back."""
    n = views.notices(spark, d).select("item_idx", "published", "agency", F.regexp_extract("title", "^[A-Za-z]*", 0).alias("word"))
    page = F.expr("item_idx div 50")
    link = F.concat(F.lit("<a href='view.do?id="), F.col("item_idx").cast("string"), F.lit("'>["), "agency", F.lit("] 새글 Post "), "word", F.lit(" &amp; 안내 "), F.col("item_idx").cast("string"), F.lit("호</a>"))
    day = F.coalesce(F.date_format("published", "yyyy.MM.dd"), F.lit(""))
    table = F.concat(F.lit("<tr><td>1</td><td>"), link, F.lit(" 조회 3</td><td>팀</td><td>"), day, F.lit("</td><td><a href='f.hwp'>첨부파일 이름이 아주 길어 제목보다 긴 경우.hwp</a></td></tr>"))
    item = F.concat(F.lit("<li>"), link, F.lit("<span>"), day, F.lit("</span></li>"))
    each = n.select(page.alias("page_id"), "item_idx", F.when(page % 2 == 0, table).otherwise(item).alias("row"))
    # A page has fifty rows at most.
    html = each.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_idx", "row"))), lambda x: x["row"]), "").alias("rows"))
    captured = html.select("page_id", F.lit("https://b.kr/list.do").alias("url"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<table>"), "rows", F.lit("</table>"))).otherwise(F.concat(F.lit("<ul>"), "rows", F.lit("</ul>"))).alias("html"))
    return boards.rows(captured).select("page_id", "title", "url", "unit", "published")


@query
def feed_sniff(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    body = F.concat(F.when(F.col("page_id") % 3 == 0, "<RSS version='2'>").when(F.col("page_id") % 3 == 1, "<html>").otherwise("<feed>"), F.when(F.col("page_id") % 2 == 0, "<item >").otherwise(""), "html")
    return p.select("page_id", pages.is_feed(F.encode(body, "UTF-8")).alias("feed"))


@query
def slot_scores(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.element_at(F.array(*map(F.lit, oracle.SLOT_LABELS)), (F.col("page_id") % len(oracle.SLOT_LABELS) + 1).cast("int")).alias("label"))
    slot = labels.slot_of(F.col("label"))
    return p.select("page_id", "label", slot.alias("slot"), labels.slot_score(slot, F.col("label"), F.col("url")).cast("int").alias("score"))


@query
def links_enriched(spark, d):
    n = _current(spark, d, "agency", "published", "url", "rights")
    kind = "array<struct<label:string,url:string,kind:string>>"
    links = n.select("url", F.array(F.struct(F.lit("첨부").alias("label"), F.concat("url", F.lit("/a.pdf")).alias("url"), F.lit("PDF").alias("kind"))).cast(kind).alias("links"))
    return collect.enriched(n, links).select("item_idx", F.size("links").alias("links"))


@query
def web_fresh(spark, d):
    n = _current(spark, d, "url", "org")
    seen = n.where("item_idx % 3 = 0 and org <> 'org2'").select("org", "url")
    return collect.fresh(n, seen).select("item_idx", "is_fresh")


@query
def web_filtered(spark, d):
    n = collect.within_days(views.notices(spark, d), NOW, 400)
    return collect.filtered(n, "채용", "", "TH").select("item_idx", "title")


@query
def external_urls(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", T.host(F.col("url")).alias("host"), T.is_external(F.col("url"), "www.example.com").alias("external"))


@query
def attachment_kind(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    url = F.concat(F.col("url"), F.element_at(F.array(*map(F.lit, ("", ".pdf", ".HWP", ".docx?x=1", ".zip#a", ".csv"))), (F.col("page_id") % 6 + 1).cast("int")))
    return p.select("page_id", pages.attachment_kind(url).alias("kind"))


@query
def mined_urls(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    script = F.concat(F.lit('<script>var a="/bbs/list.do?menuNo='), F.col("page_id").cast("string"), F.lit('", b="https:\\/\\/x.example.com\\/board\\/list", c="'), F.regexp_replace("url", "[?#].*$", ""), F.lit('/notice/bbs/", d="/a.css"</script>'))
    return pages.mined_urls(p.select("page_id", "url", F.concat("html", script).alias("html")))


@query
def page_anchors(spark, d):
    return pages.anchors(spark.read.parquet(f"{d}/pages.parquet"))


@query
def rss_rows(spark, d):
    n = views.notices(spark, d)
    esc = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>"), esc("title"), F.lit("</title><link>"), F.col("url"), F.lit("</link><pubDate>"), F.coalesce(F.col("published").cast("string"), F.lit("")), F.lit("</pubDate></item>"))
    feed = F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>"))
    return feeds.rss(n.select(F.col("item_idx").alias("src_idx"), F.encode(feed, "UTF-8").alias("bytes"))).select("src_idx", "title", "url", "published")


@query
def datago_rows(spark, d):
    n = views.notices(spark, d)
    fields = F.struct(F.col("title").alias("nttSj"), F.col("url").alias("link"), F.col("published").cast("string").alias("regDate"))
    one = F.to_json(F.struct(F.struct(F.struct(F.struct(fields.alias("item")).alias("items")).alias("body")).alias("response")))
    many = F.to_json(F.struct(F.array(fields, fields).alias("data")))
    return feeds.open_data(n.select(F.col("item_idx").alias("src_idx"), F.when(F.col("item_idx") % 4 == 0, F.to_json(F.array(fields))).when(F.col("item_idx") % 2 == 0, one).otherwise(many).alias("json"))).select("src_idx", "item_idx", "title", "url", "published")


@query
def deep_links(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return pages.deep_links(pages.anchors(p).withColumn("url", F.concat("url", F.when(F.col("pos") % 2 == 0, ".pdf").otherwise(""))))


@query
def url_shapes(spark, d):
    known = oracle.URLS
    u = views.notices(spark, d).select("item_idx", F.element_at(F.array(*map(F.lit, known)), (F.col("item_idx") % len(known) + 1).cast("int")).alias("url"))
    url = F.col("url")
    return u.select("item_idx", urls.looks_like_home(url).alias("home"), urls.looks_like_article(url).alias("article"), urls.looks_like_search(url).alias("search"))


@query
def alt_urls(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.array_join(urls.alternates(F.col("url")), " ").alias("urls"))


@query
def category_from_url(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    url = F.concat(F.col("url"), F.element_at(F.array(*map(F.lit, oracle.PATHS)), (F.col("page_id") % len(oracle.PATHS) + 1).cast("int")))
    return p.select("page_id", urls.category_of(url).alias("category"))


@query
def audit_report(spark, d):
    rows = routes.tried(_attempts(spark, d)).groupBy("src_idx", "category").agg(F.max(F.col("ok").cast("int")).alias("ok"), F.sum(F.when(F.col("ok"), F.col("n_rows")).otherwise(0)).alias("n"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("boards"), F.count_if(F.col("ok") == 1).alias("connected"), F.sum("n").alias("rows"))


@query
def file_kinds(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    pick = lambda values, step: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("page_id") / step) % len(values) + 1).cast("int"))
    rows = p.select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), pick(oracle.FILE_TAILS, 1)).alias("url"), pick(oracle.FILE_LABELS, len(oracle.FILE_TAILS)).alias("text"))
    return rows.select("page_id", files.looks_like_file(F.col("url")).alias("file"), files.kind(F.col("url"), F.col("text")).alias("kind"), files.clean_label(F.col("text")).alias("label"))


@query
def sitemap_rows(spark, d):
    """Pages as the entries of sitemaps, ten each."""
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.expr("page_id div 10").alias("page_id"), F.concat(F.lit("<url><loc> "), F.regexp_replace("url", r"[?#].*$", ""), F.lit("/board/list.do </loc></url>")).alias("x"))
    # Ten rows to a sitemap.
    maps = p.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("html"))
    return gateway.sitemap(maps)


@query
def home_variants(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.array_join(gateway.host_variants(F.col("url")), " ").alias("sites"))
