"""Hand values, causality, and independent numpy forms of the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import cross as C
from panelwright.functions import pointwise as X
from panelwright.functions import window as T
from panelwright.operators import displacement as R
from panelwright.operators import evaluate as E
from panelwright.operators import panel as P
from panelwright.sources import archives as A
from panelwright.sources import tables as S

T0 = dt.datetime(2024, 1, 1)


def hours(spark, values, symbol="a", name="x"):
    rows = [(symbol, T0 + dt.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"symbol string, ts timestamp_ntz, {name} double")


def column(df, expr):
    return [r[0] for r in df.select("ts", expr.alias("v")).orderBy("ts").select("v").collect()]


def test_windows_need_every_value(spark):
    df, w, x = hours(spark, [1, 2, None, 4, 8, 16]), T.series(), F.col("x")
    assert column(df, T.ts_mean(x, 3, w)) == [None] * 5 + [28 / 3]
    assert column(df, T.ts_sum(x, 2, w)) == [None, 3, None, None, 12, 24]
    assert column(df, T.ts_delay(x, 2, w)) == [None, None, 1, 2, None, 4]
    assert column(df, T.ts_delta(x, 1, w)) == [None, 1, None, None, 4, 8]
    assert column(df, T.ts_return(x, 1, w)) == [None, 1, None, None, 1, 1]
    assert column(df, T.ts_std(x, 2, w)) == [None, 0.5, None, None, 2, 4]


def test_rolling_rank_averages_ties(spark):
    assert column(hours(spark, [1, 3, 3, 3]), T.ts_rank(F.col("x"), 3, T.series())) == [None, None, 0.75, 0.5]
    assert column(hours(spark, [1, 3]), T.ts_rank(F.col("x"), 1, T.series())) == [None, None]


def test_constant_side_has_no_correlation(spark):
    df = hours(spark, [1, 1, 1, 2]).withColumn("y", F.col("ts").cast("timestamp").cast("double"))
    assert column(df, T.ts_corr(F.col("x"), F.col("y"), 3, T.series()))[2] is None
    assert column(df, T.ts_corr(F.col("x"), F.col("y"), 3, T.series()))[3] == pytest.approx(math.sqrt(3) / 2)


def test_domains(spark):
    df = hours(spark, [0.0, -4.0, float("inf"), None])
    x = F.col("x")
    assert column(df, X.log(x)) == [None, None, None, None]
    assert column(df, X.sqrt(x)) == [0, None, None, None]
    assert column(df, X.div(F.lit(1.0), x))[0] is None
    assert column(df, X.smaller(x, F.lit(1.0))) == [0, -4, 1, None]
    assert column(df, X.power(x, -1))[0] is None


def test_cross_rank_and_eligibility(spark):
    rows = [("a", 1.0, True), ("b", 1.0, True), ("c", 9.0, True), ("d", 0.0, True), ("e", 5.0, True), ("f", 7.0, False), ("g", None, True)]
    df = spark.createDataFrame([(s, T0, v, e) for s, v, e in rows], "symbol string, ts timestamp_ntz, x double, eligible boolean")
    got = {r["symbol"]: r["r"] for r in C.cross_rank(df, "x", "r").collect()}
    assert got == {"a": 0.375, "b": 0.375, "c": 1.0, "d": 0.0, "e": 0.75, "f": None, "g": None}
    assert {r["z"] for r in C.cross_zscore(df.where("symbol in ('a', 'b')"), "x", "z").collect()} == {None}


@pytest.mark.parametrize("operator", ["mean", "rank", "rsi"])
def test_the_future_does_not_change_the_past(spark, operator):
    values = np.random.default_rng(5).normal(size=40)
    changed = values.copy()
    changed[30:] += 100

    def run(v):
        df = hours(spark, v)
        if operator == "rsi":
            return [r["rsi"] for r in T.ts_rsi(df, "x", 5).orderBy("ts").collect()]
        return column(df, {"mean": T.ts_mean, "rank": T.ts_rank}[operator](F.col("x"), 5, T.series()))

    assert run(values)[:30] == run(changed)[:30]


def test_rsi_against_numpy(spark):
    v = np.random.default_rng(3).normal(size=60).cumsum()
    d = np.diff(v)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    a, b = up[:14].mean(), down[:14].mean()
    want = [None] * 14 + [100 * a / (a + b)]
    for u, w in zip(up[14:], down[14:], strict=True):
        a, b = (a * 13 + u) / 14, (b * 13 + w) / 14
        want.append(100 * a / (a + b))
    got = [r["rsi"] for r in T.ts_rsi(hours(spark, v), "x", 14).orderBy("ts").collect()]
    assert got[:14] == want[:14] and np.allclose(got[14:], want[14:])
    assert [r["rsi"] for r in T.ts_rsi(hours(spark, [1, 1, 1]), "x", 2).orderBy("ts").collect()] == [None, None, 50.0]


def test_hac_against_kernel_matrix(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0.2, 1, 60)
    x[[5, 17]] = np.nan
    good = np.isfinite(x)
    n = good.sum()
    u = np.where(good, x - x[good].mean(), 0)
    lag = np.abs(np.subtract.outer(np.arange(60), np.arange(60)))
    kernel = np.clip(1 - lag / 5, 0, None)
    se = math.sqrt(u @ kernel @ u / n**2 * n / (n - 1))
    df = hours(spark, [None if math.isnan(v) else v for v in x]).withColumn("k", F.lit(1))
    row = E.with_p_values(E.hac(df, "x", ["k"], 4, 20)).first()
    assert row["se"] == pytest.approx(se) and row["n"] == n and row["grid_periods"] == 60
    assert row["p_value"] == pytest.approx(math.erfc(abs(x[good].mean() / se) / math.sqrt(2)))
    assert E.hac(df, "x", ["k"], 4, 100).first()["status"] == "insufficient_evidence"


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.03), ("c", None)], "test string, p_value double")
    got = {r["test"]: (r["q_value"], r["rejected"]) for r in E.benjamini_hochberg(df, 0.05).collect()}
    assert got["a"] == (pytest.approx(0.03), True) and got["b"] == (pytest.approx(0.045), True) and got["c"] == (1.0, False)


def test_reversed_ranks_displace_by_a_half(spark):
    rows = [(f"s{i}", T0 + dt.timedelta(hours=h), float(i if h == 0 else 5 - i), True) for i in range(6) for h in (0, 1)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, f double, eligible boolean")
    got = {r["ts"]: r for r in R.displacement(df, "f", [1], [], 3).collect()}
    assert got[T0]["status"] == "boundary_excluded" and got[T0 + dt.timedelta(hours=1)]["d"] == pytest.approx(0.5)


def test_tied_values_share_a_group(spark):
    rows = [(f"s{i}", T0, float(f), True, float(i), False) for i, f in enumerate([1, 1, 1, 2, 3, 3])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, f double, eligible boolean, forward_return double, purged boolean")
    row = E.periods(df.withColumn("k", F.lit(1)), "f", ["k"], 3, 3).first()
    assert (row["group_1_n"], row["group_2_n"], row["group_3_n"]) == (3, 1, 2) and row["status"] == "computed"


def test_as_of_takes_the_whole_latest_row(spark):
    left = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h)) for h in range(3)], "symbol string, at timestamp_ntz")
    events = spark.createDataFrame([("a", T0, 1.0, 5.0), ("a", T0 + dt.timedelta(hours=2), None, 6.0)], "symbol string, event_ts timestamp_ntz, x double, y double")
    got = [(r["event"]["x"], r["event"]["y"]) for r in P.as_of(left, events, "at", "event_ts").orderBy("at").collect()]
    assert got == [(1.0, 5.0), (1.0, 5.0), (None, 6.0)]


def test_funding_window_statuses(spark):
    at = [(0, 1e-4), (8, 1e-4), (16, 1e-4), (24, 1e-4), (40, 1e-4), (48, None)]
    events = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h), r, 8.0) for h, r in at], "symbol string, event_ts timestamp_ntz, rate double, interval_hours double")
    left = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h)) for h in (-1, 7, 25, 41, 49)], "symbol string, available_at timestamp_ntz")
    got = [(r["funding_status"], r["funding_sum"]) for r in P.funding_window(left, events, 24).orderBy("available_at").collect()]
    assert [s for s, _ in got] == ["missing_event", "insufficient_history", "valid", "missing_settlement", "missing_settlement"]
    assert got[2][1] == pytest.approx(3e-4)


def test_epoch_units_and_quarantine(spark):
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,), (1_700_000_000_000_000,), (1_700_000_000_000_000_000,)], "t long")
    assert {r[0] for r in df.select(S.epoch_millis(F.col("t"))).collect()} == {1_700_000_000_000}
    bars = spark.createDataFrame([("a", 0, 3_599_999, 1.0, 2.0, 1.0, 1.5, 1.0, 1, 0.5), ("a", 3_600_000, 7_199_999, 1.0, 0.5, 1.0, 1.5, 0.0, 2, None)], "symbol string, open_time long, close_time long, open double, high double, low double, close double, volume double, trades long, taker_volume double")
    got = {r["open_time"]: r["reasons"] for r in S.quarantine(bars).collect()}
    assert got[0] == [] and got[3_600_000] == ["missing_field", "inconsistent_zero_volume", "high_low_bounds"]


def test_sinks_round_trip(spark, tmp_path):
    df = hours(spark, [1, 2, 3])
    A.write_partitioned(df, str(tmp_path / "p"), "symbol")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    S.write_report(df, str(tmp_path / "c"))
    S.write_report(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 6
