"""Levels that a value equals: quantiles to the last bit, and energy_events, against DuckDB."""

import math
import random

import duckdb

from spanloom.operators import spans as sp
from spanloom.plans import registry


def test_quantiles_equal_duckdb_to_the_last_bit(spark):
    r = random.Random(7)
    rows = [(k, round(r.expovariate(0.02), 2)) for k in range(300) for _ in range(1 + k % 70)]
    rows += [(300 + k, r.choice([0.1, 10.57, 33.3])) for k in range(60) for _ in range(2 + k)]
    rows += [(400, None), (401, None), (401, 2.5), (402, math.inf), (402, 1.0), (402, 2.0), (403, -math.inf), (403, math.inf), (404, -0.7), (404, 1e300), (405, math.inf), (405, math.inf)]
    rows += [(406, math.nan), (406, 1.0), (406, 3.0)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {x.k: (repr(x.low), repr(x.top)) for x in sp.quantiles(df, ["k"], "v", {"low": 0.2, "top": 0.99}).collect()}
    lines = df.toArrow()  # noqa: F841
    want = duckdb.sql("SELECT k, quantile_cont(v, 0.2e0), quantile_cont(v, 0.99e0) FROM lines GROUP BY k HAVING count(v) > 0").fetchall()
    assert got == {k: (repr(low), repr(top)) for k, low, top in want} and 400 not in got


def test_energy_events_at_a_level(spark, tmp_path):
    """Values that equal the opening or the closing level; the query was a window late or lost the event."""
    lines = {
        1: [38.79, 53.18, 74.25, 42.96, 46.01, 75.55, 76.03, 100.0],
        2: [6.61, 61.7, 33.48, 62.23, 27.24, 30.34, 78.0, 100.0],
        3: [10.57, 19.57, 60.0, 10.57, 10.57, 15.57, 60.0, 99.0],
    }
    rows = [(100 * u + i, u, "view", v) for u, line in lines.items() for i, v in enumerate(line)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df = df.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id) AS ts", "user_id", "event_type", "value", "'{}' AS props")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((x.video, x.start, x.end) for x in registry.QUERIES["energy_events"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.ORACLES["energy_events"]).fetchall())
    assert got[:2] == [(1, 0.5, 1.0), (1, 1.5, 2.25)]
