"""Operators that have SQL return what DuckDB returns."""

import duckdb
import pytest

from edgeloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall())
