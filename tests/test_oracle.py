"""Every query that has SQL returns what DuckDB returns."""

import duckdb
import pytest

from edgeloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(values):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(name, spark, sf, duck):
    got = plans.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    found = duck.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows_of(got.select(*(f"`{c}`" for c in columns)).collect()) == rows_of(tuple(r[i] for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
