"""Every query that has a SQL twin gives its rows; every other one runs."""

import duckdb
import pytest

import __spark_entry__ as entry
from foliant import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalog.oracle_sql():
        assert mine
        return
    out = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in out.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
