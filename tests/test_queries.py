"""Every registered query runs over the smallest tables, and gives what its SQL gives in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from tests.conftest import rows_of
from tessera import registry
from tessera.sources.tables import TABLES, path_of

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path_of(small, t)}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = rows_of(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        other = duck.sql(SQL[name])
        assert sorted(other.columns) == sorted(df.columns)
        assert got == rows_of(other.columns, other.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
