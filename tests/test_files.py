from pyspark.sql import functions as F

from noticeflow.functions import files
from noticeflow.plans import render
from noticeflow.sources import gateway


def test_files(spark):
    rows = [
        ("http://a/f/공고.hwp", "공고문.hwpx (크기:0.056MB , 다운로드:15)", "", True, "HWP", "공고문.hwpx"),
        ("http://a/get.do?mode=download&fileNameOrg=a%20b.pdf", "다운로드", "", True, "파일", "a b.pdf"),
        ("http://a/fileDown.do?id=1", "미리보기 (새창)", "첨부 자료집", True, "보기", "자료집"),
        ("http://a/allZipDown.do?atchFileId=3", "일괄 다운로드", "", False, "ZIP", "첨부 모두 받기"),
        ("http://a/support/download", "안내 페이지", "", True, "", "안내 페이지"),
        ("http://a/x.png", "[1.2MB]", "", True, "그림", "x.png"),
        ("http://a/v.do?id=3", "글", "", False, "", "글"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "url string, text string, title string")
    got = df.select(files.looks_like_file(df.url).alias("f"), files.kind(df.url, df.text).alias("k"), files.label(df.text, df.title, df.url).alias("l")).collect()
    assert [tuple(r) for r in got] == [r[3:] for r in rows]
    long = spark.createDataFrame([("가" * 100 + ".hwpx",)], "c string")
    assert long.select(files.shorten(long.c)).head()[0] == "가" * 74 + "….hwpx"


def test_joining_addresses(spark):
    from urllib.parse import urljoin

    bases = ("http://h.kr", "http://h.kr/", "http://h.kr/a/b.do?q=1#f", "https://h.kr/a/b/")
    refs = ("c.do", "/c", "?x=2", "#t", "//o.kr/z", "http://z.kr/1", "../c", "./c", "../../../c?d", "", "mailto:a@b", "d/..")
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for x in df.select("b", "r", gateway.join(df.b, df.r).alias("u")).collect():
        assert x.u == urljoin(x.b, x.r), (x.b, x.r)


def test_gateways_and_sitemaps(spark):
    pages = [
        (1, "http://h.kr/", "<meta http-equiv='refresh' content='0; url=/main/'><script>location.href = \"sub/index.do\"; top.location='http://h.kr/'</script>"),
        (2, "http://h.kr/", "<frameset><frame name='f' src='a.do'><frame src='b.css'></frameset>"),
        (3, "http://h.kr/", "Object Moved <a href='/new'>here</a>"),
        (4, "http://h.kr/", "<meta http-equiv='refresh' content='0;url=/x'>" + " " * 5000),
        (5, "http://h.kr/sitemap.xml", "<urlset><url><loc>http://h.kr/about</loc></url><url><loc> http://h.kr/bbs/notice/list.do </loc></url></urlset>"),
        (6, "http://h.kr/", 'var p = "/siteDomain/" + location.host + ".json";'),
        (7, None, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {}
    for r in gateway.targets(df).orderBy("page_id", "place").collect():
        got.setdefault(r.page_id, []).append(r.url)
    assert got == {1: ["http://h.kr/main/", "http://h.kr/sub/index.do"], 2: ["http://h.kr/a.do"], 3: ["http://h.kr/new"]}
    assert [r.url for r in gateway.sitemap(df).orderBy("place").collect()] == ["http://h.kr/bbs/notice/list.do", "http://h.kr/about"]
    assert [r.url for r in gateway.config_urls(df).collect()] == ["http://h.kr/siteDomain/h.kr.json"]
    homes = spark.createDataFrame([("https://www.h.kr/x",), ("",)], "home string")
    assert [r[0] for r in homes.select(gateway.host_variants(homes.home)).collect()] == [["https://www.h.kr", "https://h.kr"], []]
    families = spark.createDataFrame([(0, "f", 0, "/a"), (0, "f", 1, "/b"), (1, "g", 0, "/c")], "fam_ord int, family string, path_ord int, path string")
    order = [r.url for r in gateway.probe_order(homes.where("home <> ''"), families, 5).orderBy("place").collect()]
    assert order == ["https://www.h.kr/a", "https://h.kr/a", "https://www.h.kr/c", "https://h.kr/c", "https://www.h.kr/b"]


def test_briefs_and_small_texts():
    issues = [{"section_ord": 2, "pos": 1, "section": "b", "title": "t|2", "score": 4, "n": 1, "matched": list("wxyz")}, {"section_ord": 1, "pos": 1, "section": "a", "title": "t1", "score": 9, "n": 3}]
    b = render.Brief("theme", issues, 10, "now")
    assert render.brief(b, "md").index("## a") < render.brief(b, "md").index("## b") and "t\\|2 (4점, 1건; w, x, y)" in render.brief(b, "md")
    assert '"evidence": [' in render.brief(b, "json") and "<h2>a</h2>" in render.brief(b, "html")
    assert render.wide("가a") == 3 and render.progress(3, 10, 6.0) == (30, 14.0) and render.progress(0, 0, 0) == (0, -1.0)
    table = render.access_table([{"org": "가나", "verdict": "full", "allowed": 2, "paths": 2}, {"org": "b", "verdict": "blocked", "allowed": 0, "paths": 1}])
    assert table.splitlines()[0].startswith("b     0/1") and F is not None
    assert '"_verified": true' in render.draft_sources([{"id": "x", "_verified": 1}])
