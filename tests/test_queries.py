"""Every query of the engine against its SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from plinth.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda x: f"{float(x):.9g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_has_rows(spark, tiny, name):
    assert not QUERIES[name](spark, tiny).isEmpty()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert not e.entry(spark).isEmpty()
