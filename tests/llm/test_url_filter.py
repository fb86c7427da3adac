import math

from noticeflow.llm import url_filter as u

URLS = [
    (1, "https://Blog.Example.com/en/7198#top", "blog.example.com", "/en/7198", "example.com/en/7", "allow"),
    (2, "http://a.example.com/en/88", "a.example.com", "/en/88", "com/en/", "block"),
    (3, "http://example.net/de/812", "example.net", "/de/812", "example.net/de/8", "block"),
    (4, "http://x.net/de/1?u=/es/", "x.net", "/de/1", "net/de/", "block"),
    (5, "http://notcom/en/1", "notcom", "/en/1", None, None),
    (6, "no scheme com/en/", "", "", None, None),
    (7, None, "", "", None, None),
    (8, "x://É.org/es/ñ\n#a", "É.org", "/es/ñ\n", "org/es/", "block"),
    (9, "a://b?c://d/e", "b", "", None, None),
    (10, "a://" + "b" * 3000 + "/" + "c" * 100_000, "b" * 3000, "/" + "c" * 100_000, None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, x, "clash") for i, x, *_ in URLS], "page_id long, url string, host string")
    got = {r.page_id: r for r in u.judge(df).collect()}
    for i, _, host, path, rule, verdict in URLS:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and verdict in (None, r.verdict)
    assert u.judge(df.limit(0)).collect() == []


def test_model_is_the_gradient_descent(spark):
    t = u.Training(n=3, buckets=16, epochs=3)
    table = (("http://ads.x/click", 1), ("http://news.x/story", 0), ("", 0))
    host, path = u.host_and_path(__import__("pyspark.sql.functions", fromlist=["col"]).col("url"))
    rows = spark.createDataFrame([(x,) for x, _ in table], "url string").select(u.buckets(host, path, t).alias("b")).collect()
    w = [0.0] * 17
    for _ in range(t.epochs):
        for r, (_, y) in zip(rows, table, strict=True):
            x = [1.0] + [float(k in r.b) for k in range(16)]
            g = t.step * (y - 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True)))))
            w = [a * (1 - t.decay) + g * b for a, b in zip(w, x, strict=True)]
    assert max(abs(a - b) for a, b in zip(w, u.train(spark, table, t), strict=True)) < 1e-9


def test_seeds_are_learned(spark):
    rows = u.judge(spark.createDataFrame(list(u.SEED_URLS), "url string, y int"), rules=()).collect()
    assert all((r.verdict == "block") == bool(r.y) for r in rows)


#: Hosts and words that the seeds do not hold as they are here.
UNSEEN = (
    ("https://casino-win.example.com/en/12", 1), ("http://www.free-bets.example.net/fr/80?page=2", 1), ("https://cheap-pills.example.org/es/7", 1),
    ("http://spam-farm.example.com/en/9", 1), ("https://ads-track.example.net/en/33.html", 1), ("http://adult-x.example.com/fr/3", 1),
    ("https://pokerroom.io/join", 1), ("http://trackers.co/click/88", 1), ("https://big-jackpots.eu/en/1", 1), ("http://mytorrents.se/en/5", 1),
    ("https://city-library.gov/en/12", 0), ("http://www.oldmuseum.example.org/fr/3.html", 0), ("https://ththon.example.com/en/9", 0), ("http://blog.tionble.example.net/de/77", 0),
    ("https://universities.example.com/papers/1.pdf", 0), ("http://m.therou.example.net/en/4", 0), ("https://gardens.example.com/", 0), ("https://schoolnews.org/notices/3", 0),
    ("http://bakery.fr/en/20", 0), ("https://mountains.example.org/2021/3/story", 0),
)


def test_unseen_hosts(spark):
    rows = u.judge(spark.createDataFrame(list(UNSEEN), "url string, y int"), rules=()).collect()
    wrong = [r.url for r in rows if (r.verdict == "block") != bool(r.y)]
    assert len(wrong) <= 2, wrong


def test_the_model_blocks_pages(spark, sf):
    rows = u.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule is null").collect()
    bad = [r for r in rows if __import__("re").search("casino|bets|pills|ads-|spam|adult", r.host)]
    caught = sum(r.verdict == "block" for r in bad)
    stray = sum(r.verdict == "block" for r in rows) - caught
    assert caught >= 0.9 * len(bad) > 0 and stray <= 0.02 * len(rows)


#: The list of the contract, in its own words, and hosts and paths that each rule alone decides.
CONTRACT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
DECIDED = {
    "com/en/": ("a.com/en/1", "example.com/en/8", "com/en/"),
    "example.com/en/7": ("example.com/en/7", "b.example.com/en/71"),
    "net/de/": ("a.net/de/1", "example.net/de/7", "casino.net/de/click/1", "net/de/"),
    "example.net/de/8": ("example.net/de/8", "b.example.net/de/81"),
    "org/es/": ("a.org/es/1", "example.org/es/", "org/es/"),
}


def test_verdicts_are_those_of_the_contract(spark, tmp_path):
    from noticeflow.llm.queries import op6_url_filter

    words = {rule: verdict for verdict, rule in (r.split(" ") for r in CONTRACT.split(", "))}
    assert {rule: verdict for verdict, rule in u.RULES} == words
    rows = [(i, f"http://{x}?q#a", rule) for i, (rule, x) in enumerate((rule, x) for rule, each in DECIDED.items() for x in each)]
    spark.createDataFrame(rows, "page_id long, url string, fits string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in op6_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, words[rule]) for i, _, rule in rows}
