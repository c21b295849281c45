"""Every query with a SQL counterpart gives the same rows as DuckDB on the same files."""

import os

import pytest

from stancelake.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def canon(rows):
    return sorted(tuple("NULL" if r[k] is None else f"{r[k]:.6f}" if isinstance(r[k], float) else str(r[k]) for k in sorted(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rel = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon([r.asDict() for r in df.collect()]) == canon([dict(zip(rel.columns, r)) for r in rel.fetchall()])


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
