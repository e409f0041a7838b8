"""Hand values of cohorts, field hours, structural faults, universe faults, labelled support and audit totals."""

import datetime as dt

from pyspark.sql import functions as F

from panelwright.operators import comparison, liquidations, panel
from panelwright.sources import archives as A

START = dt.datetime(2024, 1, 1)


def hour(i):
    return START + dt.timedelta(hours=i)


def test_cohort_takes_the_median_and_both_markets(spark):
    def bars(symbol, volumes, hours=48):
        return [(symbol, hour(i), 1.0, float(volumes[i // 24])) for i in range(hours)]

    spot = [*bars("steady", [5, 5]), *bars("spike", [1, 8.5]), *bars("late", [9, 9], 47), *bars("named", [9, 9]), *bars("BTCUP", [9, 9]), *bars("alone", [9, 9]), ("zero", hour(0), 0.0, 9.0), *bars("zero", [9, 9])[1:]]
    perp = [*bars("steady", [1, 1]), *bars("spike", [1, 1]), *bars("late", [1, 1]), *bars("named", [1, 1]), *bars("BTCUP", [1, 1]), *bars("zero", [1, 1])]
    schema = "symbol string, ts timestamp_ntz, close double, volume double"
    got = panel.cohort({"spot": spark.createDataFrame(spot, schema), "perp": spark.createDataFrame(perp, schema)}, 48, spark.createDataFrame([("named",)], "symbol string"), 5).orderBy("place").collect()
    assert [(r["symbol"], r["median_volume"], r["place"]) for r in got] == [("steady", 120.0, 1), ("spike", 114.0, 2)]


def test_excluded_symbols_and_field_hours(spark):
    rows = [("a", hour(0), 1.0, 2.0, True), ("a", hour(1), 2.0, 3.0, True), ("b", hour(0), 1.0, 2.0, True), ("c", hour(0), None, None, False)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, close double, eligible boolean")
    made = panel.next_bar_panel(df)
    assert [(r["symbol"], r["next_return"]) for r in made.collect()] == [("a", 0.5)]
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "symbol string")
    assert {tuple(r) for r in panel.excluded_symbols(asked, df, made).collect()} == {("b", "no_next_bar"), ("c", "no_bars"), ("d", "no_bars")}
    (hours,) = panel.field_hours(df, ["close"], 2).collect()
    assert (hours["eligible"], hours["valid"], hours["full_times"], hours["times"]) == (3, 3, 1, 2)


def test_structural_faults_of_liquidations(spark):
    close = lambda i: hour(i + 1) - dt.timedelta(milliseconds=1)
    sound = ["s", "s", hour(0), "valid_zero", close(0), close(0), close(0), 0, 0, 0, 0.0, 0.0]
    names = ["symbol", "file_symbol", "ts", "status", "close_ts", "available_at", "received", "events", "long_events", "short_events", "long_notional", "short_notional"]
    cases = [{}, {"file_symbol": "x", "ts": hour(1), "close_ts": close(1)}, {"status": "valid", "ts": hour(2), "close_ts": close(2)}, {"ts": hour(3)}, {"ts": hour(4), "close_ts": close(4), "received": close(9), "available_at": close(4)}, {"ts": hour(5), "close_ts": close(5), "events": None}]
    rows = [tuple((dict(zip(names, sound, strict=True)) | c).values()) for c in [*cases, {"ts": hour(6), "close_ts": close(6)}, {"ts": hour(6), "close_ts": close(6)}, {"ts": hour(7) + dt.timedelta(minutes=5), "close_ts": close(7) + dt.timedelta(minutes=5)}]]
    kinds = "symbol string, file_symbol string, ts timestamp_ntz, status string, close_ts timestamp_ntz, available_at timestamp_ntz, received timestamp_ntz, events long, long_events long, short_events long, long_notional double, short_notional double"
    got = sorted((r["ts"].hour, r["fault"]) for r in liquidations.structure_faults(spark.createDataFrame(rows, kinds)).collect())
    assert got == [(1, "symbol_mismatch"), (2, "unknown_status"), (3, "wrong_close"), (4, "received_after_available"), (5, "nonzero_valid_zero"), (6, "repeated_key"), (7, "off_hour")]


def test_faults_of_a_universe_through_aliases(spark):
    rows = [("a", hour(0), True), ("1000a", hour(0), True), ("a", hour(1), None), ("b", hour(0), False), ("b", hour(0), False), ("b", hour(1) + dt.timedelta(minutes=30), False)]
    grid = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, eligible boolean")
    got = {(r["violation"], r["symbol"], r["ts"], r["rows"]) for r in A.universe_faults(grid, spark.createDataFrame([("1000a", "a")], "alias string, market string")).collect()}
    half = hour(1) + dt.timedelta(minutes=30)
    assert got == {("alias_duplicate", "a", hour(0), 2), ("unknown_membership", "a", hour(1), 1), ("repeated", "b", hour(0), 2), ("off_hour", "b", half, 1), ("missing", "b", hour(1), 0), ("never_eligible", "b", hour(0), 3)}


def test_labelled_support(spark):
    rows = [(1, hour(0), "a", True, 0.5, 1.0), (1, hour(0), "b", True, None, 1.0), (1, hour(1), "a", True, 0.5, None), (1, hour(1), "b", False, 0.5, 1.0), (4, hour(0), "a", True, 0.5, float("nan"))]
    df = spark.createDataFrame(rows, "horizon int, ts timestamp_ntz, symbol string, eligible boolean, forward_return double, x double")
    got = {r["horizon"]: tuple(r)[1:] for r in comparison.labelled_support(df, ["x"], 1).collect()}
    assert got == {1: (3, 2, 2, 1, 1), 4: (1, 1, 0, 0, 0)}


def test_source_precedence_and_catalogue(spark):
    new = spark.createDataFrame([("a", 1, 1.0, None, "n1")], "symbol string, k int, rate double, mark_price double, source_path string")
    old = spark.createDataFrame([("a", 1, 9.0, 7.0, "o1"), ("b", 1, 2.0, None, None)], new.schema)
    got = {(r["symbol"], r["rate"], r["mark_price"], r["source_path"], r["origin"]) for r in A.funding(new, old, old.select("symbol", "k", "mark_price"), ["symbol", "k"]).collect()}
    assert got == {("a", 1.0, 7.0, "n1", "new"), ("b", 2.0, None, None, "legacy")}
    bars = spark.createDataFrame([("a", hour(0)), ("a", hour(1)), ("b", hour(2))], "symbol string, ts timestamp_ntz")
    assert {(r["dataset"], r["interval"], r["symbols"], r["rows"]) for r in A.catalog([("bars", "1h", bars), ("events", None, bars.limit(0))]).collect()} == {("bars", "1h", 2, 3)}
    cover = A.consolidated_coverage(bars.where("symbol = 'a'"), bars.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")))
    assert {(r["symbol"], r["rows"], r["source"]) for r in cover.collect()} == {("a", 2, "consolidated"), ("b", 1, "legacy")}
