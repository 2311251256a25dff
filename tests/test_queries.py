"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from folio.plans import registry


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def connection(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, connection, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = connection.execute(sql)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
