"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from panelwright.plans import registry
from panelwright.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _plain(row):
    return tuple(None if isinstance(x, float) and math.isnan(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    found = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.oracle_sql()[name]})")
    assert sorted(duck.sql(registry.oracle_sql()[name]).columns) == columns
    a, b = sorted((_plain(r) for r in got.select(*columns).collect()), key=repr), sorted((_plain(r) for r in found.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-6, abs_tol=2e-4)) for u, v in zip(x, y, strict=True)), (x, y)


def test_online_rsi_over_all_users(spark):
    """The whole stream against the plain recursion."""
    got = {(r["symbol"], r["ts"]): r["rsi"] for r in registry.queries()["st_online_rsi_all"](spark, SF).collect()}
    series, want = {}, {}
    for symbol, ts, value in sorted(duckdb.sql(f"SELECT event_type, ts, value FROM '{SF}/events.parquet'").fetchall()):
        series.setdefault(symbol, []).append((ts, value))
    for symbol, rows in series.items():
        gain = loss = 0.0
        for k, (ts, value) in enumerate(rows):
            if k:
                up, down = max(value - rows[k - 1][1], 0), max(rows[k - 1][1] - value, 0)
                gain, loss = (gain + up / 14, loss + down / 14) if k <= 14 else (gain + (up - gain) / 14, loss + (down - loss) / 14)
            want[symbol, ts] = None if k < 14 else 50.0 if gain + loss == 0 else 100 * gain / (gain + loss)
    assert got.keys() == want.keys()
    assert all(got[k] == v or math.isclose(got[k], v, rel_tol=1e-6, abs_tol=2e-4) for k, v in want.items())


def test_online_rsi_of_many_keys_in_two_batches(spark):
    """Thousands of keys, a null one and missing values among them, go to Python together and on from their states."""
    rng = np.random.default_rng(2)
    rows = [("ab"[i % 2], None if i % 1999 == 0 else int(i % 2000), i, None if rng.random() < 0.01 else float(rng.integers(0, 9))) for i in range(60_000)]
    made = lambda part: spark.createDataFrame(part, "symbol string, user_id long, at long, value double").selectExpr("symbol", "user_id", "timestamp_micros(at) ts", "value")
    keys, state = ["symbol", "user_id"], "symbol string, user_id long, micros long, previous double, seen double, gain double, loss double"
    first = jobs.rsi_of_keys(made(rows[:35_000]), spark.createDataFrame([], state), 5, keys).cache()
    both = [first, jobs.rsi_of_keys(made(rows[35_000:]), first.where("last"), 5, keys)]
    got = {r["micros"]: r["rsi"] for part in both for r in part.where("not old").collect()}
    series = {}
    for symbol, user, at, value in rows:
        series.setdefault((symbol, user), []).append((at, value))
    want = {}
    for part in series.values():
        before, seen, gain, loss = None, 0, 0.0, 0.0
        for at, value in part:
            if value is None or before is None:
                seen, gain, loss, want[at] = 0, 0.0, 0.0, None
            else:
                seen, up, down = seen + 1, max(value - before, 0) / 5, max(before - value, 0) / 5
                gain, loss = (gain + up, loss + down) if seen <= 5 else (gain * 0.8 + up, loss * 0.8 + down)
                want[at] = None if seen < 5 else 50.0 if gain + loss == 0 else 100 * gain / (gain + loss)
            before = value
    assert got.keys() == want.keys()
    assert all(got[k] == v or math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())


def test_queries_without_sql_have_stable_rows(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    assert found.columns == ["ts", "n", "rank_ic"] and found.where("rank_ic is not null").count() > 50
