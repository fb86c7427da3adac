"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from noticeflow.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rows = sorted(([r[c] for c in names] for r in df.collect()), key=str)
    assert rows
    if name in catalog.ORACLE_SQL:
        got = duck.execute(catalog.ORACLE_SQL[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == names
        want = sorted(([r[columns.index(c)] for c in names] for r in got.fetchall()), key=str)
        assert str(rows) == str(want)
