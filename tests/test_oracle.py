"""Every query with a DuckDB counterpart gives its rows at the smallest size."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from corvid.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_rows_match(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in registry.ORACLE:
        assert got
        return
    want = duck.sql(registry.ORACLE[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_every_counterpart_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
