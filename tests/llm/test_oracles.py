"""The operators' queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from spanloom.llm import registry

TABLES = "documents benchmark pages".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(repr([r[c] for c in names]) for r in df.toArrow().to_pylist())
    cursor = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(repr([dict(zip(columns, r, strict=True))[c] for c in names]) for r in cursor.fetchall())
    assert got == want
