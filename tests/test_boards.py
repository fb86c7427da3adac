"""Board lists of many shapes against rows written down by hand."""

from datetime import date

import pytest

from noticeflow.functions import labels as L
from noticeflow.functions import text as T
from noticeflow.operators import boards
from noticeflow.sources import boards as source

D = date


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def table(*rows):
    return "<table>" + "".join(rows) + "</table>"


def dated(n):
    return [row(f"<a href='/z/{i}'>filler row {i}</a>", f"2023.01.0{i}") for i in range(1, n + 1)]


FILLER = [(f"filler row {i}", f"http://h.kr/z/{i}", "", D(2023, 1, i)) for i in (1, 2)]

PAGES = {
    "unit, badge, first date after the title": (table(row("1", "<a href='v?id=1'>[도서관] 새글 사서 모집</a>", "2024.03.05", "2024.04.01")), [("사서 모집", "http://h.kr/b/v?id=1", "도서관", D(2024, 3, 5))]),
    "script address": (table(row("2", "<a href='#' onclick=\"go('/b/view.do?id=2')\">스크립트 글</a>", "24.03.06")), [("스크립트 글", "http://h.kr/b/view.do?id=2", "", D(2024, 3, 6))]),
    "script without address": (table(row("<a href='javascript:fn(3)'>주소 없는 글</a>", "2024-03-07")), [("주소 없는 글", "http://h.kr/b/list.do#%EC%A3%BC%EC%86%8C%20%EC%97%86%EB%8A%94%20%EA%B8%80", "", D(2024, 3, 7))]),
    "script title with a file": (table(row("<a href='javascript:fn(3)'>자료 있는 글</a>", "<a href='/f/longer-name-than-title.hwp'>longer-name-than-title.hwp</a>", "2024-03-07")), [("자료 있는 글", "http://h.kr/f/longer-name-than-title.hwp", "", D(2024, 3, 7))]),
    "file name as title": (table(row("<a href='r.pdf'>규정집 전문 자료</a>", "2024-03-08")), [("규정집 전문 자료", "http://h.kr/b/r.pdf", "", D(2024, 3, 8))]),
    "plain title and a download button": (table(row("예결산 공고문", "2024-03-09", "<a href='d.pdf'>다운로드</a>")), [("예결산 공고문", "http://h.kr/b/d.pdf", "", D(2024, 3, 9))]),
    "plain title without date is none": (table(row("안내문 제목", "<a href='d.pdf'>다운로드</a>")), []),
    "undated file rows go among dated ones": (table(*dated(2), row("<a href='x.hwp'>첨부 규칙 전문.hwp</a>", "")), FILLER),
    "same address once": (table(*dated(2), row("<a href='/z/1'>filler again</a>", "2023.05.05")), FILLER),
    "echoed tail": (table(row("<a href='/v/9'>참여 안내 학생팀 2024-10-08 157</a>", "학생팀", "2024-10-08", "157")), [("참여 안내", "http://h.kr/v/9", "", D(2024, 10, 8))]),
    "hidden tail with a date becomes a cell": (table(row("<a href='/v/8'>모집 공고문</a> 새글 작성일 2024.05.06")), [("모집 공고문", "http://h.kr/v/8", "", D(2024, 5, 6))]),
    "icon fonts": (table(row("<a href='/v/7'><i class='material-icons'>lock</i>잠긴 글 제목</a>", "2024.05.07")), [("잠긴 글 제목", "http://h.kr/v/7", "", D(2024, 5, 7))]),
    "secret, spam, pages, buttons": (table(*(row(f"<a href='/q/{i}'>{t}</a>", "2024.01.01") for i, t in enumerate(("비밀글입니다 열람 불가", "온라인 카지노 안내", "1 2 3 4 다음", "자세히보기", "https://a.kr/only")))), []),
    "items": ("<ul><li><a href='/menu'>메뉴 이름</a></li><li><a href='/n/1'><b>목록 첫 글</b><span>2024.01.02</span></a></li><li><span>2024-01-03</span><a href='/n/2'>목록 둘째 글</a></li></ul>", [("목록 첫 글", "http://h.kr/n/1", "", D(2024, 1, 2)), ("목록 둘째 글", "http://h.kr/n/2", "", D(2024, 1, 3))]),
    "references escaped twice": (table(row("<a href='/v/6'>산학 &amp;lsquo;협력&amp;rsquo; &amp;mid</a>", "2024.06.01")), [("산학 ‘협력’", "http://h.kr/v/6", "", D(2024, 6, 1))]),
    "broken": ("<table><tr><td><a href='/v/5'>열린 채로 끝나는 글", []),
    "nothing": (None, []),
}


def test_posts(spark):
    names = list(PAGES)
    df = spark.createDataFrame([(i, "http://h.kr/b/list.do", PAGES[n][0]) for i, n in enumerate(names)], "page_id long, url string, html string")
    got = {n: [] for n in names}
    for r in boards.rows(df).orderBy("page_id", "pos").collect():
        got[names[r.page_id]].append((r.title, r.url, r.unit, r.published))
    for n in names:
        assert got[n] == PAGES[n][1], n
    assert boards.rows(df.limit(0)).collect() == []


def test_k2web_lists(spark):
    post = "/bbs/s/12/345/artclView.do"
    html = table(row("고정", f"<a href='{post}'>공지 하나</a>", "학사팀", "2024.05.01", "77"), row("1", f"<a href='{post}?layout=unknown'>공지 하나</a>"), row("2", "<a href=\"javascript:go('/bbs/s/12/346/artclView.do')\">둘</a>", "12", "24.05.02"), row("<a href='/menu'>메뉴</a>"))
    df = spark.createDataFrame([(1, "https://k.kr/bbs/s/12/artclList.do", html)], "page_id long, url string, html string")
    assert [(r.title, r.url, r.unit, r.published) for r in boards.k2web_rows(df).collect()] == [("공지 하나", "https://k.kr" + post, "학사팀", D(2024, 5, 1)), ("둘", "https://k.kr/bbs/s/12/346/artclView.do", "24.05.02", D(2024, 5, 2))]


def test_feed_index_and_page_label(spark):
    html = "<title>홈 | 장학공지 | 어느대학교</title><h1>안내</h1>" + table(row("알림 > 소식 > 채용", "<a href='/rss/a.xml'>주소복사</a>"), row("x", "<a href='/a'>b</a>"))
    df = spark.createDataFrame([(1, "http://h.kr/", html)], "page_id long, url string, html string")
    assert [(r.name, r.url) for r in boards.feed_index(df).collect()] == [("채용", "http://h.kr/rss/a.xml")]
    assert boards.lists(df).head().label == "장학공지"


def test_decoding():
    assert source.decode("가나".encode("cp949")) == "가나" == source.decode("가나".encode())
    assert source.decode(b"\xff\xfe\xfa") and source.decode(None) == ""


@pytest.mark.parametrize(
    ("raw", "want"),
    [("- 학사공지", "학사공지"), ("공지사항(목록)", "공지사항"), ("더보기READ", ""), ("더 보기", ""), ("학사더보기", "학사"), ("학사 더", "학사"), ("리더", "리더"), ("HUFS Professors 더보기", "HUFS Professors"), ("그림자의+밤", "그림자의 밤"), ("게시판목록", ""), (None, ""), ("  ", "")],
)
def test_tidy_label(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "c string")
    assert df.select(L.tidy_label(df.c).alias("x")).head().x == want


def test_clean_titles(spark):
    cases = {
        "새글 안내문 제목": ("안내문 제목", ""), "[기획처] NEW 안내문 제목": ("안내문 제목", "기획처"), "안내문 제목 새글 첨부파일이 1개 있음": ("안내문 제목", ""), "채용 공고문 인사총무팀 조회수 62": ("채용 공고문", ""),
        "기술 공고문 담당부서 정책과 등록일 2026.10.08 조회 37": ("기술 공고문", ""), "교외장학 New 첨부파일 2026 선발": ("교외장학 2026 선발", ""), "조회(1건) 안내": ("조회(1건) 안내", ""), "Happy New Year": ("Happy New Year", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: (r.t.title, r.t.unit) for r in df.select("c", L.clean_title(df.c).alias("t")).collect()} == cases


def test_dates(spark):
    cases = {
        "등록일 2024.07.20": D(2024, 7, 20), "(20240720)": D(2024, 7, 20), "Tue, 05 Mar 2024 10:00": D(2024, 3, 5), "2024년 7월 2일(화)": D(2024, 7, 2), "24.7.2 마감": D(2024, 7, 2), "2025-13-40 24.01.01": None,
        "게시2026.07.20": None, "1.24.07.20": None, "20260230": None, "5 Foo 2024": None, "": None, None: None, "202607201": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.d for r in df.select("c", T.parse_date(df.c).alias("d")).collect()} == cases
