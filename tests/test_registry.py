import json
from datetime import date

from pyspark.sql import functions as F

from noticeflow.functions import urls as U
from noticeflow.operators import routes
from noticeflow.sources import registry


def test_reading_and_rules(spark, tmp_path):
    items = [
        {"name": " A ", "kind": "rss", "url": "http://a/x", "rights": "KOGL_TYPE1", "topics": [" t ", ""]},
        {"name": "B", "url": "http://b"},
        {"name": "C", "kind": "k2web", "host": "h", "site_id": "s", "board_id": "12", "menu_no": "x"},
        {"name": "D", "kind": "k2web", "host": "h", "site_id": "s"},
        {"name": "E", "kind": "govorg", "home": "http://e", "routes": [["공지", "board"], ["공지", "board", " u "]]},
        {"name": "F", "kind": "ftp", "url": "u"},
        {"name": "", "url": "u"},
        {"name": "G", "kind": "datago"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(items), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"sources": [{"id": "z", "name": "Z", "url": "http://z", "enabled": False}]}), encoding="utf-8")
    got = {r.name: r for r in registry.read(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["A", "B", "C", "E", "Z"]
    assert (got["A"].id, got["A"].rights, got["A"].topics, got["A"].row) == ("src-0", "kogl_type1", ["t"], 50)
    assert (got["C"].board_id, got["C"].menu_no) == (12, None) and [tuple(r) for r in got["E"].routes] == [("공지", "board", "u")]
    assert [r.id for r in registry.enabled(registry.read(spark, str(tmp_path))).where("name = 'Z'").collect()] == []
    planned = {(r.stage, r.url) for r in registry.stages(registry.read(spark, str(tmp_path))).where("src_idx = 2").collect()}
    assert planned == {("rss", "https://h/bbs/s/12/rssList.do?row=50"), ("list", "https://h/bbs/s/12/artclList.do")}


def test_notices_take_what_their_source_has(spark):
    raw = spark.createDataFrame([(0, "A", "govorg", "http://a/", "기관")], "src_idx int, name string, kind string, home string, org string")
    for c in registry.RAW.split(", "):
        name, kind = c.replace("`", "").split(" ", 1)
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast(kind))
    rows = spark.createDataFrame([(0, 1, "t", "/v?1", date(2024, 1, 1), "", "http://a.kr/list.do?mid=3&x=1"), (0, 2, "", "u", None, "", "u"), (9, 1, "t", "u", None, "", "u")], "src_idx int, item_idx int, title string, url string, published date, unit string, from_url string")
    (r,) = registry.notices(rows, registry.typed(raw), F.lit("board")).collect()
    assert (r.url, r.agency, r.org, r.unit, r.site, r.rights) == ("http://a.kr/v?1", "A", "기관", "A", "A", "unknown")
    assert r.origin == "a.kr · 게시판 · /list.do?mid=3"


def test_addresses(spark):
    df = spark.createDataFrame([("http://a/b?type=xml",), ("http://a/b",), ("http://a/b?serviceKey=z",)], "u string")
    assert [r[0] for r in df.select(U.datago(df.u, "k/+")).collect()] == ["http://a/b?type=xml&serviceKey=k%2F%2B", "http://a/b?serviceKey=k%2F%2B&type=json", "http://a/b?serviceKey=z&type=json"]
    assert [r[0] for r in df.select(U.datago(df.u, None)).collect()] == [None, None, "http://a/b?serviceKey=z&type=json"]
    odd = spark.createDataFrame([(" http://a/가 b%20c ",)], "u string")
    assert odd.select(U.safe(odd.u)).head()[0] == "http://a/%EA%B0%80%20b%20c"
    long = spark.createDataFrame([("https://h.kr/" + "a" * 60 + "/list.do?bbsId=B&mid=1&page=3",)], "u string")
    assert long.select(U.origin_label(long.u, F.lit("rss"))).head()[0] == "h.kr · RSS 피드 · /" + "a" * 22 + "…" + "a" * 15 + "/list.do?bbsId=B&mid=1"
    keys = spark.createDataFrame([("https://H/bbs/s/1/rssList.do?row=5",), ("https://h/bbs/s/1/artclList.do#x",), ("https://h/bbs/s/1/9/artclView.do",)], "u string")
    assert [r[0] for r in keys.select(U.board_key(keys.u)).collect()] == ["k2:h/bbs/s/1/", "k2:h/bbs/s/1/", "https://h/bbs/s/1/9/artclview.do"]


def test_press_feed_is_asked_last(spark):
    rows = [(1, "보도자료", 0, 0, "rss", True, True, 0), (1, "보도자료", -1, 9, "korea", True, True, 4), (2, "보도자료", 0, 0, "rss", True, True, 3), (2, "보도자료", -1, 9, "korea", True, True, 4), (3, "공지", 0, 0, "board", False, True, 0), (3, "공지", 0, 1, "alt", True, True, 2), (3, "공지", 0, 2, "alt", True, True, 9), (4, "공지", 0, 0, "board", True, False, 0), (4, "공지", 1, 0, "board", False, False, 0)]
    df = spark.createDataFrame(rows, "src_idx int, category string, route int, stage_ord int, stage string, robots_ok boolean, fetched boolean, n_rows int")
    got = routes.by_route(df)
    assert {(r.src_idx, r.route): (r.stage, r.n_rows, r.ok) for r in got.collect()} == {(1, 0): ("", 0, False), (1, -1): ("korea", 4, True), (2, 0): ("rss", 3, True), (3, 0): ("alt", 2, True), (4, 0): ("", 0, False), (4, 1): ("", 0, False)}
    assert {r.src_idx: r.trails for r in routes.failures(got).collect()} == {4: "board: fetch failed / board: robots"}
