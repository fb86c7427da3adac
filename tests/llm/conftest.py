import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdeilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls in every column, empty and blank texts, one very long text, and repeated rows."""
    rng = random.Random(6)
    long = " ".join(rng.choice(words) for _ in range(60_000))
    return [
        (None, None, None, None, None),
        (1, None, "en", "s", 0),
        (2, "", "en", "s", 0),
        (3, " \t\n\x0b\r ", None, "s", 5),
        (4, "one two three", "en", None, 13),
        (4, "one two three", "en", None, 13),
        (5, "Ünïcode größe ñandú 日本語 テキスト", "de", "s", None),
        (6, long, "en", "s", len(long)),
        (7, "x" * 200_000, "en", "s", 200_000),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows, with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, DOCS)
    for name in ("n", "score", "keys", "kept", "spans", "_w", "_first", "block", "uid", "host", "n_words", "class_hist"):
        df = df.withColumn(name, F.lit("clash"))
    return df
