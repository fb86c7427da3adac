"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

A rule fits its host and all subdomains when the path starts with the rule's path; of the
rules that fit, the longest wins.  Other URLs get the verdict of a model that is trained
from a small labelled table by stochastic gradient descent, written as one SQL aggregate
over the rows of that table, and applied as SQL expressions.  No Python runs per row.  The
table is made by rule from words of hosts and from paths; no host of it is one of the rules'.

A null URL, or one without ``://``, has empty host and path and gets the model's verdict.
Rows are kept one for one, repeated or not; an empty table gives an empty result.  Columns
named host, path, rule, verdict or block_score give way to the results.  Of rules of equal
length that both fit, the last by code points wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.llm.hof import let, upto

# The rules, as (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: Words of hosts that are blocked, and of hosts that are not; paths that both kinds have,
#: and paths of one kind.
BAD_WORDS = (
    "casino", "poker", "slots", "jackpot", "bets", "betting", "free-spins", "lottery", "win-prize", "pills", "cheap-meds", "viagra", "replica", "adult",
    "porn", "xxx", "cams", "escort", "ads", "adserver", "banner-ads", "tracker", "track-click", "popunder", "spam", "link-farm", "backlinks", "warez",
    "torrent", "crack-keygen", "payday-loan", "fast-cash", "account-verify", "claim-bonus", "cheap-watches", "dating-hot",
)
GOOD_WORDS = (
    "library", "museum", "university", "school", "weather", "science", "history", "garden", "recipes", "kitchen", "forum", "journal", "gazette", "council",
    "hospital", "transport", "archive", "wiki", "docs", "research", "theatre", "orchestra", "football", "cycling", "travel", "hotel", "village", "station",
    "engineering", "software", "metro", "press", "theatrics", "notion", "nation", "thorn", "throne", "heather", "other", "thing", "retina", "linen",
)
PLAIN_PATHS = ("/en/{n}", "/fr/{n}.html", "/de/{n}/", "/2021/{n}/story", "/", "/index.html", "/es/{n}?page=2")
BAD_PATHS = ("/click/{n}", "/banner/{n}.gif", "/bonus/order/{n}", "/redirect?offer={n}")
GOOD_PATHS = ("/article/{n}", "/library/book/{n}", "/notices/{n}", "/papers/{n}.pdf")


def seed_urls() -> tuple[tuple[str, int], ...]:
    """The labelled table, (url, 1 for those to block): each word in two hosts, by rule."""
    ends, fronts = ("com", "net", "org", "info"), ("", "www.", "blog.", "m.")
    out = []
    for label, words, own in ((1, BAD_WORDS, BAD_PATHS), (0, GOOD_WORDS, GOOD_PATHS)):
        for i, word in enumerate(words):
            paths = (*PLAIN_PATHS, *own)
            for k, host in enumerate((word, f"{word}{'-' if label else ''}{words[(5 * i + 7) % len(words)]}")):
                j = 2 * i + k
                path = paths[(3 * j) % len(paths)].format(n=(37 * j) % 991)
                out.append((f"http{'s' * (j % 2)}://{fronts[(j // 2) % 4]}{host}.{ends[(i + k) % 4]}{path}", label))
    # In turn, so that the descent sees both labels all along.
    bad, good = ([r for r in out if r[1] == label] for label in (1, 0))
    return tuple(r for i in range(max(len(bad), len(good))) for side in (bad, good) for r in side[i : i + 1])


SEED_URLS = seed_urls()


@dataclass(frozen=True)
class Training:
    """n-gram length, buckets, passes over the labelled table, step and decay."""

    n: int = 4
    buckets: int = 8192
    epochs: int = 20
    step: float = 0.1
    decay: float = 1e-4
    threshold: float = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    value = F.coalesce(url, F.lit(""))
    at = F.instr(value, "://")
    rest = F.when(at > 0, F.substr(value, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, below = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + below)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(kind: str, value: Column, t: Training) -> Column:
    def of(chars: Column) -> Column:
        return F.transform(
            upto(F.size(chars) - t.n + 1),
            lambda i: F.pmod(F.xxhash64(F.lit(kind), *(F.element_at(chars, i + j) for j in range(t.n))), F.lit(t.buckets)).cast("int"),
        )

    return let(F.split(F.concat(F.lit("^"), value, F.lit("$")), ""), of)


def buckets(host: Column, path: Column, t: Training = Training()) -> Column:
    """Distinct bucket numbers of the n-grams of host and path."""
    return F.array_distinct(F.concat(_grams("host", host, t), _grams("path", path, t)))


def train(spark: SparkSession, labelled=SEED_URLS, t: Training = Training()) -> list[float]:
    """Bias and weights, from labelled rows (url, 0 or 1), by stochastic gradient descent.

    The table is small by its nature: it is written by hand or by rule.  Weights are sums of
    rows, so the descent keeps one factor for each row, and what it needs of the rows is how
    many buckets any two share; the number of buckets costs nothing.
    """
    host, path = host_and_path(F.col("url"))
    rows = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(labelled)], "i int, url string, y double").select(
        "i", "y", buckets(host, path, t).alias("x")
    )
    table = rows.agg(F.array_sort(F.collect_list(F.struct("i", "y", "x"))).alias("rows"))
    # Every row holds the bias, too.
    shared = F.transform("rows", lambda r: F.struct(r["i"].alias("i"), r["y"].alias("y"), F.transform("rows", lambda s: F.size(F.array_intersect(r["x"], s["x"])) + 1).alias("k")))
    table = table.withColumn("met", shared)

    def step(factors: Column, r: Column) -> Column:
        z = F.aggregate(F.zip_with(factors, r["k"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return let(
            (r["y"] - 1.0 / (1.0 + F.exp(-z))) * t.step,
            lambda g: F.transform(factors, lambda a, j: a * (1.0 - t.decay) + F.when(j == r["i"], g).otherwise(0.0)),
        )

    factors = F.aggregate(F.flatten(F.array_repeat(F.col("met"), t.epochs)), F.transform("rows", lambda _: F.lit(0.0)), step)
    each = table.withColumn("f", factors).select(F.explode(F.arrays_zip("rows", "f")).alias("r")).select("r.f", "r.rows.x")
    parts = each.select("f", F.explode(F.concat(F.array(F.lit(-1)), "x")).alias("k"))
    # One row for each bucket at most comes to the driver.
    found = {r["k"]: r["w"] for r in parts.groupBy("k").agg(F.sum("f").alias("w")).collect()}
    return [found.get(k, 0.0) for k in range(-1, t.buckets)]


def _literal(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def judge(pages: DataFrame, url: str = "url", rules=RULES, labelled=SEED_URLS, t: Training = Training()) -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_score (the model's, 0 to 1)."""
    w = train(pages.sparkSession, labelled, t)
    host, path = host_and_path(F.col(url))
    out = pages.withColumn("host", host).withColumn("path", path)
    total = F.aggregate(
        buckets(F.col("host"), F.col("path"), t),
        F.lit(w[0]),
        lambda s, k: s + F.element_at(_literal(w[1:]), k + 1),
    )
    hit = rule_for(F.col("host"), F.col("path"), rules)
    return (
        out.withColumn("block_score", 1.0 / (1.0 + F.exp(-total)))
        .withColumn("rule", hit["rule"])
        .withColumn("verdict", F.coalesce(hit["verdict"], F.when(F.col("block_score") >= t.threshold, "block").otherwise("allow")))
    )
