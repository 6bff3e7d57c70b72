"""Queries of the catalog against their SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest
from chainsift.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{v:.8g}")
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    want = duck.sql(catalog.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert got == sorted(([plain(v) for v in r] for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
