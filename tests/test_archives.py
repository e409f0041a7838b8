"""Archives, partitioned upserts, paging, universe files, and many factors at once, against plain versions."""

import datetime as dt
import glob
import math
import os
import random

import numpy as np
from pyspark.sql import functions as F

from panelwright.operators import gram, panel, ranking, signals
from panelwright.sources import archives as A

START = dt.datetime(2024, 1, 1)


def files(folder, symbol):
    return {(f, os.stat(f).st_mtime_ns) for f in glob.glob(f"{folder}/symbol={symbol}/*.parquet")}


def test_upsert_rewrites_only_its_partitions(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = [(s, i, float(i), 0) for s in "abc" for i in range(20)]
    schema = "symbol string, k long, x double, load int"
    A.write_partitioned(spark.createDataFrame(rows, schema), folder, "symbol", spread="k")
    before = {s: files(folder, s) for s in "abc"}
    A.upsert_partitions(spark, folder, spark.createDataFrame([("b", 3, -3.0, 1), ("b", 99, 9.0, 1), ("d", 0, 1.0, 1)], schema), ["symbol", "k"], "load")
    after = {s: files(folder, s) for s in "abc"}
    assert after["a"] == before["a"] and after["c"] == before["c"] and not after["b"] & before["b"]
    want = {(s, k, -3.0 if (s, k) == ("b", 3) else x) for s, k, x, _ in rows} | {("b", 99, 9.0), ("d", 0, 1.0)}
    assert {(r["symbol"], r["k"], r["x"]) for r in spark.read.parquet(folder).collect()} == want


def test_only_partitions_without_a_manifest_are_read(spark, tmp_path):
    folder = str(tmp_path / "t")
    A.write_partitioned(spark.createDataFrame([(s, START + dt.timedelta(days=i)) for s in "abc" for i in range(5)], "symbol string, ts timestamp"), folder, "symbol")
    manifest = spark.createDataFrame([("a", 77, dt.date(2020, 1, 1), dt.date(2020, 1, 31))], "symbol string, rows long, first date, last date")
    archive = spark.read.parquet(folder)
    symbols = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "symbol string")
    made = A.coverage_or_scan(symbols, manifest, archive)
    got = {r["symbol"]: tuple(r)[1:] for r in made.collect()}
    day = lambda i: dt.date(2024, 1, 1 + i)
    assert got == {"a": (77, dt.date(2020, 1, 1), dt.date(2020, 1, 31), "manifest"), "b": (5, day(0), day(4), "scan"), "c": (5, day(0), day(4), "scan"), "z": (0, None, None, "scan")}
    assert "dynamicpruning" in made._jdf.queryExecution().executedPlan().toString()


def test_pages_of_tied_values(spark):
    draw = random.Random(1)
    rows = [(None if draw.random() < 0.05 else draw.choice([1.0, 1.0, 1.0, 2.0, draw.random() * 9]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, k long")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for offset, limit in ((0, 5), (40, 120), (1500, 30), (2990, 30), (3500, 5)):
        got = A.page(df, ["x", "k"], offset, limit, ranges=8, most=50)
        assert [(r["x"], r["k"]) for r in got.orderBy(F.asc_nulls_first("x"), "k").collect()] == ordered[offset : offset + limit]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and ("TakeOrderedAndProject" in plan or offset >= 3000)
        assert all(r["total"] == 3000 for r in got.collect())
    assert A.page(df.limit(0), ["x", "k"], 0, 5).count() == 0


def test_universe_lines_and_their_reasons(spark, tmp_path):
    path = tmp_path / "u.csv"
    lines = [
        "2024-01-01T00:00:00Z,a,true", "2024-01-01T01:00:00+00:00,a,FALSE", "2024-01-01T02:00:00Z,a,maybe", "2024-01-01T03:00:00,a,1", "nonsense", "2024-01-01T04:00:00Z,a,1,more", "2024-01-01T05:10:00Z,a,0",
        "2024-13-01T05:00:00Z,a,0", "2024-01-01T06:00:00Z,,0", "2024-01-01T07:00:00Z,b,0", "2024-01-01T07:00:00Z,b,1", "2023-12-01T00:00:00Z,a,1", ",a,1",
    ]
    path.write_text("\n".join(["timestamp,symbol,eligible", *lines]) + "\n")
    good, bad = A.membership(spark, str(path), "2024-01-01 01:00:00", "2024-01-02 00:00:00", 1)
    assert sorted((r["symbol"], r["eligible"]) for r in good.collect()) == [("a", False), ("a", True)]
    reasons = ["bad_token", "no_zone", "malformed_line", "malformed_line", "off_hour", "bad_time", "no_symbol", "repeated_key", "repeated_key"]
    assert sorted(map(tuple, bad.collect())) == sorted([*zip(lines[2:11], reasons, strict=True), (lines[12], "no_zone")])
    assert good.count() == 2 and bad.count() == 10  # pruned columns don't change what is malformed


def test_many_factors_in_blocks(spark):
    draw = np.random.default_rng(4)
    k, times, symbols = 200, 6, 12
    x = draw.normal(size=(times, symbols, k))
    x[draw.random(x.shape) < 0.1] = np.nan
    x[:, :, 7] = 0.1  # never varies
    x[0, :, 9] = np.nan
    x[1, 3:, 11] = np.nan
    rows = [(f"f{f:03d}", START + dt.timedelta(days=3 * t), f"s{s}", float(x[t, s, f])) for t in range(times) for s in range(symbols) for f in range(k) if not np.isnan(x[t, s, f])]
    import pyarrow as pa

    long = spark.createDataFrame(pa.table([*map(pa.array, zip(*rows, strict=True))], ["factor", "ts", "symbol", "value"]))
    got = {(r["left"], r["right"]): r for r in ranking.similarity(long, 5, 3).collect()}
    assert len(got) == k * (k - 1) // 2
    for i, j in [(0, 1), (3, 150), (7, 8), (2, 7), (9, 10), (11, 12), (31, 32), (198, 199)]:
        rs, few, flat = [], 0, 0
        for t in range(times):
            both = ~np.isnan(x[t, :, i]) & ~np.isnan(x[t, :, j])
            a, b = x[t, both, i], x[t, both, j]
            if not both.any():
                continue
            if both.sum() < 5:
                few += 1
            elif np.ptp(a) == 0 or np.ptp(b) == 0:
                flat += 1
            else:
                rs.append(np.corrcoef(a, b)[0, 1])
        r = got[f"f{i:03d}", f"f{j:03d}"]
        assert (r["insufficient"], r["constant"], r["valid"]) == (few, flat, len(rs))
        assert r["mean"] is None if len(rs) < 3 else math.isclose(r["mean"], np.mean(rs), abs_tol=1e-9)


def test_correlation_of_nearly_constant_columns():
    x = np.array([[1e9, 1.0], [1e9, 2.0], [1e9 + 1e-6, 3.0], [np.nan, 4.0]])
    n, r = gram.gram_correlations(x, x)
    assert n.tolist() == [[3, 3], [3, 4]] and np.isnan(r[0, 0]) == (np.ptp(x[:3, 0]) == 0)
    big = np.column_stack([1e8 + np.array([0.0, 1, 2, 3.5]), np.array([3.0, 1, 2, 0])])
    assert np.allclose(gram.gram_correlations(big, big)[1], np.corrcoef(big.T))


def test_growth_from_the_bar_before_the_window(spark):
    days = [START + dt.timedelta(days=i) for i in range(6)]
    net = [0.5, 0.1, 0.2, -0.5, 0.3, 0.0]
    path = spark.createDataFrame([("k", t, x, x / 2, 1.0) for t, x in zip(days, net, strict=True)] + [("dead", days[0], 0.1, 0.0, 0.0), ("dead", days[3], -1.0, 0.0, 0.0)], "symbol string, ts timestamp_ntz, net double, benchmark double, turnover double")
    got = {(r["symbol"], r["window"]): r for r in signals.window_growth(path, {"all": ("2024-01-01", "2025-01-01"), "late": ("2024-01-03", "2024-01-05"), "none": ("2030-01-01", "2031-01-01")}, ["symbol"]).collect()}
    assert {*got} == {("k", "all"), ("k", "late"), ("dead", "all"), ("dead", "late")}
    late = got["k", "late"]
    assert (late["anchor_ts"], late["last_ts"], late["bars"]) == (days[1], days[3], 2)
    equity = np.cumprod(1 + np.array(net))
    assert math.isclose(late["log_growth"], math.log(equity[3] / equity[1])) and math.isclose(late["years"], 2 / 365)
    assert math.isclose(math.exp(late["log_cagr"]), (equity[3] / equity[1]) ** (365 / 2)) and math.isclose(late["turnover_a_year"], 365)
    assert math.isclose(got["k", "all"]["log_growth"], math.log(equity[5] / equity[0])) and got["k", "all"]["anchor_ts"] == days[0]
    assert got["dead", "all"]["log_growth"] is None and got["dead", "late"]["anchor_ts"] == days[0]


def test_rollup_of_coverage(spark):
    rows = [("m", "a", True, 1.0, None), ("m", "a", True, None, None), ("m", "b", False, 2.0, None), ("n", "c", True, 3.0, None)]
    df = spark.createDataFrame(rows, "market string, symbol string, eligible boolean, x double, y double")
    got = {(r["level"], r["market"], r["field"], r["symbol"]): r for r in panel.coverage_rollup(df, ["x", "y"], spark.createDataFrame([("x", 2)], "field string, needed int")).collect()}
    assert (got[0, "m", "x", "a"]["rows"], got[0, "m", "x", "a"]["valid"], got[0, "m", "x", "a"]["ready"]) == (2, 1, False)
    assert (got[1, "m", "x", None]["eligible"], got[1, "m", "x", None]["valid"]) == (2, 1)
    assert (got[3, "n", None, None]["covered"], got[3, "n", None, None]["uncovered"]) == ("x", "y")
    assert (got[7, None, None, None]["rows"], got[7, None, None, None]["covered"]) == (8, "x") and got[1, "n", "y", None]["ready"] is None
