import random
from datetime import date
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.operators import boards, collect, digest, greedy, relevance, routes
from noticeflow.plans import render
from noticeflow.sources import feeds, pages

NOTICE = "src_idx int, item_idx int, title string, url string, agency string, published date, summary string, category string, rights string, topics array<string>"


def notice(i, title="t", url="", agency="a", day=None, **kw):
    row = {"src_idx": i % 3, "item_idx": i, "title": title, "url": url, "agency": agency, "published": day, "summary": "", "category": "", "rights": "", "topics": []} | kw
    return tuple(row.values())


def test_first_wins_keeps_source_order_and_all_columns(spark):
    rows = [notice(5, url="HTTP://A"), notice(1, url="http://a"), notice(2, url=" http://b "), notice(3, "x  y"), notice(4, "x y"), notice(6, url=None)]
    got = collect.first_wins(spark.createDataFrame(rows, NOTICE))
    # Source 1 stands before source 2, and items in order within a source.
    assert sorted(r.item_idx for r in got.collect()) == [1, 2, 3, 6]
    assert collect.first_wins(spark.createDataFrame([], NOTICE)).count() == 0


def test_since_keeps_undated_and_zero_is_unlimited(spark):
    df = spark.createDataFrame([notice(1, day=date(2024, 1, 1)), notice(2), notice(3, day=date(2024, 6, 1))], NOTICE)
    assert sorted(r.item_idx for r in collect.since(df, "2024-06-30", 60).collect()) == [2, 3]
    assert collect.since(df, "2024-06-30", 0).count() == 3


def test_state(spark):
    df = spark.createDataFrame([notice(1, url="u1"), notice(2, url="u2")], NOTICE)
    seen = spark.createDataFrame([(0, "u1"), (1, "u1"), (2, "old")], "pos int, key string")
    assert {r.item_idx: r.is_new for r in collect.mark_new(df, seen).collect()} == {1: False, 2: True}
    assert not any(r.is_new for r in collect.mark_new(df, None).collect())
    now = spark.createDataFrame([("u2",), ("u1",)], "key string")
    assert [r.key for r in collect.merge_state(now, seen, 2).orderBy("pos").collect()] == ["u1", "u2"]


def test_keep_first_is_the_scan(spark):
    rng = random.Random(3)
    rows = [(i, f"u{rng.randrange(40)}" if rng.random() < 0.9 else None, f"t{rng.randrange(40)}" if rng.random() < 0.9 else None) for i in range(200)]
    rows += [(300, "u", "a"), (301, "u", "b"), (302, "v", "b")]
    seen, want = set(), set()
    for i, *keys in rows:
        keys = {k for k in keys if k}
        if not keys & seen:
            seen |= keys
            want.add(i)
    df = spark.createDataFrame(rows, "i int, u string, t string").repartition(5)
    assert {r.i for r in greedy.keep_first(df, F.array("u", "t"), F.col("i")).collect()} == want


def test_a_chain_of_waits_is_decided_or_an_error(spark):
    rows = spark.createDataFrame([(i, [f"k{i}", f"k{i + 1}"]) for i in range(9)] + [(9, None)], "i int, keys array<string>")
    assert {r.i for r in greedy.keep_first(rows, F.col("keys"), F.col("i")).collect()} == {0, 2, 4, 6, 8, 9}
    with pytest.raises(RuntimeError):
        greedy.keep_first(rows, F.col("keys"), F.col("i"), rounds=2)


def test_clusters_are_the_scan(spark):
    rng = random.Random(4)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    rows = []
    for i in range(150):
        words = rng.sample(vocabulary, rng.randint(0, 6))
        if rows and rng.random() < 0.5:
            words = rows[rng.randrange(len(rows))][2].split()[: rng.randint(1, 6)] + rng.sample(vocabulary, 1)
        rows.append(notice(i, " ".join(words), day=None if i % 7 == 0 else date(2024, 1, 1 + i % 28)))
    ordered = sorted(rows, key=lambda r: (-(r[5] or date.min).toordinal(), r[2], r[0], r[1]))
    leaders, want = [], {}
    for r in ordered:
        tokens = set(r[2].split())
        best = None
        for at, (own, other) in enumerate(leaders):
            sim = Fraction(len(tokens & other), len(tokens | other)) if tokens and other else 0
            if 2 * sim >= 1 and (best is None or sim > best[0]):
                best = (sim, at)
        if best is None:
            leaders.append((r[1], tokens))
            want[r[1]] = r[1]
        else:
            want[r[1]] = leaders[best[1]][0]
    got = greedy.clusters(spark.createDataFrame(rows, NOTICE)).collect()
    assert {r.item_idx: r.leader_item for r in got} == want


def test_suffix_and_tokens(spark):
    df = spark.createDataFrame([("지원하는 학교에서는 제3차 2024 안내 Street 가 지원하며",)], "t string")
    assert sorted(df.select(T.title_tokens(df.t).alias("x")).head().x) == sorted(["지원", "학교", "street"])


def test_trend_rounds_half_to_even(spark):
    weeks = lambda ns: spark.createDataFrame([(date(2024, 1, 1 + 7 * i), n) for i, n in enumerate(ns)], "week date, n long")
    assert digest.trend(weeks([4, 4, 4, 5])).head().percent == 12
    assert digest.trend(weeks([0, 0, 1, 1])).head().kind == "started"
    assert digest.trend(weeks([1, 1, 1])).head().kind == ""
    assert digest.trend(weeks([0, 0, 0, 0])).head().kind == ""
    assert digest.weekly(spark.createDataFrame([], "published date")).count() == 0


def test_theme(spark):
    theme = relevance.Theme.from_query("장학, 채용 장학")
    assert [n for n, _ in theme.sections] == ["장학", "채용"]
    with pytest.raises(ValueError):
        relevance.Theme.from_query(" , ")
    df = spark.createDataFrame([notice(1, "장학금 안내", topics=["채용"]), notice(2, "기타"), notice(3, "신입 모집", summary="장학")], NOTICE)
    got = {r.item_idx: (r.score, r.matched, r.section) for r in relevance.score(df, theme).collect()}
    assert got == {1: (4, ["장학"], "장학"), 3: (1, ["장학"], "장학")}


def test_cascade_stops_at_the_first_success(spark):
    rows = [(1, "공지", 0, "rss", False, False, 0), (1, "공지", 1, "board", True, True, 3), (1, "공지", 2, "alt", True, True, 9), (2, "공지", 0, "rss", True, False, 0), (2, "공지", 1, "board", True, True, 0)]
    df = spark.createDataFrame(rows, "src_idx int, category string, stage_ord int, stage string, robots_ok boolean, fetched boolean, n_rows int")
    got = {r.src_idx: (r.trail, r.succeeded) for r in routes.trails(df).collect()}
    assert got == {1: ("rss: robots → board: 3건", 1), 2: ("rss: fetch failed → board: no rows", 0)}


def test_feeds(spark):
    rss = b"<rss><channel><item><title>A &amp; &lt;b&gt;x&lt;/b&gt;</title><link>http://a</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0900</pubDate></item><item><title>no link</title></item></channel></rss>"
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>B</title><link rel="self" href="http://s"/><link href="http://b"/><updated>2024-03-06T00:00:00Z</updated></entry></feed>'
    bomb = b'<!DOCTYPE x [<!ENTITY a "b">]><rss><item><title>t</title><link>l</link></item></rss>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, bomb), (4, b"<rss>"), (5, None), (6, b"")], "src_idx int, bytes binary")
    got = [(r.src_idx, r.title, r.url, r.published) for r in feeds.rss(df).orderBy("src_idx").collect()]
    assert got == [(1, "A & x", "http://a", date(2024, 3, 5)), (2, "B", "http://b", date(2024, 3, 6))]
    replies = [(1, '{"response":{"body":{"items":{"item":{"nttSj":"one","regDate":"20240305"}}}}}'), (2, '{"data":[{"title":"x","link":"u"},{"title":" "}]}'), (3, "[1]"), (4, "{"), (5, None)]
    rows = feeds.open_data(spark.createDataFrame(replies, "src_idx int, json string")).collect()
    assert sorted((r.src_idx, r.title, r.url) for r in rows) == [(1, "one", ""), (2, "x", "u")]


def test_pages(spark):
    html = "<table><tr><th>no</th></tr><tr><td>1</td><td><a href='/v?id=1'>A long title</a></td><td>2024.03.05</td></tr></table><script>var x='<a href=\"/no\">no</a>'</script><a href='javascript:x()'>j</a>"
    df = spark.createDataFrame([(1, "http://h/list", html), (2, None, None)], "page_id long, url string, html string")
    assert [(r.url, r.text) for r in pages.anchors(df).collect()] == [("http://h/v?id=1", "A long title")]
    assert [(r.title, r.url, r.published) for r in boards.rows(df).collect()] == [("A long title", "http://h/v?id=1", date(2024, 3, 5))]


def test_rendering(spark):
    df = spark.createDataFrame([notice(1, "a|b <c>", "http://a", day=date(2024, 3, 5), rights="kogl_type1"), notice(2, "z", "http://z", agency="B")], NOTICE)
    report = render.Report.of(df, "2024-06-30")
    assert "a\\|b" in render.render(report, "md") and "KOGL-1" in render.render(report, "md")
    assert "&lt;c&gt;" in render.render(report, "html") and '"count": 2' in render.render(report, "json")
    assert render.template(report, "$count $nope $$") == "2 $nope $"
    with pytest.raises(ValueError):
        render.render(report, "pdf")
    assert [render.nice_max(v) for v in (0, 1, 3, 12, 51)] == [1.0, 1, 5, 20, 100]
    assert render.bars(["a"], [3]).startswith("<svg") and render.sparkline([]).startswith("<svg")


def test_stream(spark, tmp_path):
    from noticeflow.streaming import captured

    feed = b"<rss><channel><item><title>A</title><link>http://a</link></item><item><title>A2</title><link>HTTP://A</link></item></channel></rss>"
    spark.createDataFrame([(1, feed), (2, feed)], "src_idx int, bytes binary").withColumn("captured", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    q = captured.start(captured.notices(captured.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
