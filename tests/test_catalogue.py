"""Every query with SQL gives the rows that the SQL gives, on the smallest tables."""

import math
import os

import pytest

from lexigrove.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, sql, name):
    df = catalogue.queries()[name](spark, DATA)
    names = sorted(df.columns)
    ours = sorted((plain(tuple(r)) for r in df.select(*names).collect()), key=repr)
    text = catalogue.oracle_sql()[name]
    assert sorted(sql.sql(text).columns) == names
    theirs = sorted((plain(r) for r in sql.sql(f"SELECT {', '.join(names)} FROM ({text})").fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0
