"""Every registered query of the archive against its SQL."""

import datetime
import math

import duckdb
import pytest

from lakefolio.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    value = float(value)
    return None if math.isnan(value) else round(value, 4) + 0.0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sql, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = sql.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(plain(r[c]) for c in columns) for r in df.collect()) == order(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
