"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loomgraph import graph_queries, queries

DATA = "/root/testdata/sf0.001"
NAMES = [*queries.SQL, *graph_queries.SQL]

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    from compare import rows

    df = (queries.QUERIES | graph_queries.QUERIES)[name](spark, DATA)
    rel = con.sql((queries.SQL | graph_queries.SQL)[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())
