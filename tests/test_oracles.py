"""Every registered query agrees with its SQL."""

import math

import duckdb
import pytest

from quirefold import catalog
from quirefold.plans.views import TABLES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def agree(spark, sf, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, found.fetchall())
    assert len(got) == len(want)
    assert got == want
    return got


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees(spark, sf, name):
    assert agree(spark, sf, catalog.QUERIES[name], catalog.ORACLES[name])
