from pyspark.sql import functions as F

from noticeflow.functions.korean import aliases, romanize
from noticeflow.operators import discover
from noticeflow.sources import pages, robots


def test_romanize():
    assert (romanize("도서관"), romanize("날씨"), romanize("값 A1!")) == ("doseogwan", "nalssi", "gabsa1")
    assert (romanize("국립"), romanize("국립", True), romanize("밭", True)) == ("gugrib", "gukrip", "bat")
    assert aliases("도서관") == ("doseo", "doseogwan") and aliases("오") == () and aliases("국") == ("gug", "guk")


def test_robots(spark):
    rules = spark.createDataFrame([("http://a", "User-agent: *\nDisallow: /x\nCrawl-delay: 5\nRequest-rate: 1/10"), ("http://b", "")], "origin string, text string")
    df = spark.createDataFrame([("http://a/x/1",), ("http://A/y",), ("http://b/x",), ("http://c/x",), ("ftp://a/y",), (None,)], "url string")
    got = {r.url: (r.allowed, r.delay) for r in robots.checked(df, rules).collect()}
    assert got == {"http://a/x/1": (False, 10.0), "http://A/y": (True, 10.0), "http://b/x": (True, None), "http://c/x": (True, None), "ftp://a/y": (False, None), None: (False, None)}


def test_site_roots(spark):
    df = spark.createDataFrame([("www.a.ac.kr",), ("x.y.a.go.kr",), ("news.b.com",), ("b",)], "h string")
    assert [r.r for r in df.select(discover.site_root(df.h).alias("r")).collect()] == ["a.ac.kr", "a.go.kr", "b.com", "b"]


def board(n, dated):
    return "<table>" + "".join(f"<tr><td><a href='/v/{i}'>title {i}</a></td><td>{'2024.01.0' + str(i + 1) if i < dated else ''}</td></tr>" for i in range(n)) + "</table>"


def test_probe(spark):
    rows = [(1, "http://a.kr/list.do", board(4, 3)), (2, "http://a.kr/links.do", board(4, 1)), (3, "http://a.kr/one.do", board(1, 1)), (4, "http://a.kr/index.do", board(4, 4)), (5, "http://b.kr/list.do", board(4, 4)), (6, "http://a.kr/view.do", board(3, 3)), (7, "http://a.kr/none.do", None)]
    df = spark.createDataFrame([(*r, "a.kr") for r in rows], "page_id long, url string, html string, home string")
    assert {r.page_id: r.verdict for r in discover.probe(df).collect()} == {1: "list", 2: "index", 3: "static", 4: "home", 5: "external", 6: "article", 7: "static"}


def test_search_stays_on_the_site_and_in_budget(spark):
    link = lambda *us: "".join(f"<a href='{u}'>x</a>" for u in us)
    corpus = [("http://a.kr/", link("/bbs/list.do", "/about", "http://b.kr/", "http://sub.a.kr/notice")), ("http://a.kr/bbs/list.do", link("/bbs/2", "/")), ("http://sub.a.kr/notice", link("http://a.kr/deep"))]
    df = spark.createDataFrame(corpus, "url string, html string")
    seeds = spark.createDataFrame([("http://a.kr/", "http://a.kr/")], "home string, url string")
    got = {r.url: r["round"] for r in discover.search(df, seeds).collect()}
    assert got == {"http://a.kr/": 0, "http://a.kr/bbs/list.do": 1, "http://a.kr/about": 1, "http://sub.a.kr/notice": 1, "http://a.kr/bbs/2": 2, "http://a.kr/deep": 2}
    assert discover.search(df, seeds, budget=3).count() == 3


def test_deep_links(spark):
    rows = [(1, 0, "http://a/f.pdf", "더보기"), (1, 1, "http://a/v", "첨부 파일"), (1, 2, "http://a/w", "other"), *((2, i, f"http://a/{i}.zip", "z") for i in range(8))]
    got = pages.deep_links(spark.createDataFrame(rows, "page_id long, pos int, url string, text string"))
    assert [(r.label, r.kind) for r in got.where("page_id = 1").orderBy("place").collect()] == [("f.pdf", "PDF"), ("첨부 파일", "링크")]
    assert got.where("page_id = 2").agg(F.max("place")).head()[0] == 5
