"""Every core query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from spanloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.toArrow().to_pylist())
    if name not in registry.ORACLES:
        assert got
        return
    cursor = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(repr([plain(dict(zip(columns, r, strict=True))[c]) for c in names]) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
