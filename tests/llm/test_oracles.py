"""Queries of this subpackage that SQL can express."""

import duckdb
import pytest

from quirefold.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "conversations")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, sf, name):
    sf = sf.replace("0.001", "0.01")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall()) and got
