"""Selection and coverage by hand values; bar checks over days against one window a symbol; reports that keep their texts."""

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators import selection
from panelwright.sources import tables as S

T0 = dt.datetime(2024, 1, 1)


def test_members_and_thin_times(spark):
    rows = [(T0 + dt.timedelta(hours=h), x) for h, xs in ((0, [True, None, True]), (1, [False]), (30, [True])) for x in xs]
    got = selection.thin_times(selection.members(spark.createDataFrame(rows, "ts timestamp_ntz, live boolean"), F.col("live")), 2).orderBy("day").collect()
    assert [tuple(r)[1:] for r in got] == [(2, 1, 0, 2), (1, 1, 1, 1)]


def test_front_breaks_ties_by_name_and_puts_missing_scores_last(spark):
    rows = [("p", "b", 1.0), ("p", "b", 3.0), ("p", "a", 2.0), ("p", "c", None), ("q", "z", None), ("r", "y", None), ("r", "x", 9.0)]
    got = selection.front(spark.createDataFrame(rows, "parent string, variant string, score double"), "parent", "variant", "score")
    assert sorted(map(tuple, got.collect())) == [("p", "a", 2.0), ("q", "z", None), ("r", "x", 9.0)]


def test_picks_of_a_class_are_disjoint(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 5)], "class string, n int")
    got = selection.disjoint_picks(df, "class", [F.desc("n")], 3, 2)
    assert sorted(map(tuple, got.collect())) == [("a", 5, True), ("a", 6, True), ("a", 7, False), ("a", 8, False), ("a", 9, False), ("b", 5, False)]


def test_conditional_coverage_counts_null_as_absent(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, -1.0), ("b", 4, None)], "symbol string, ts int, x double")
    got = selection.conditional_coverage(df, ["symbol"], {"x": F.col("x").isNotNull(), "up": F.col("x") > 0})
    assert sorted(map(tuple, got.collect())) == [("a", 2, 1, 3, 1, 1, 1), ("b", 0, None, None, 0, None, None)]


def _bars(spark):
    hours = [0, 1, 1, 5, 23, 24, 25, 25, 49, 50, 200, None]
    rows = [(s, None if h is None else T0 + dt.timedelta(hours=h + k), 1.0, 2.0, 0.5, 3.0 if h == 5 else 1.5) for k, s in enumerate(("a", "b", None)) for h in hours]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double")


def test_quality_over_days_is_that_of_one_window(spark):
    bars = _bars(spark)
    s = bars.withColumn("_s", F.unix_seconds("ts"))
    gap = s.withColumn("g", (F.col("_s") - F.lag("_s").over(W.partitionBy("symbol").orderBy("_s"))) / 3600)
    plain = gap.groupBy("symbol").agg(F.count("*"), F.count("*") - F.countDistinct("_s"), ((F.max("_s") - F.min("_s")) / 3600).cast("long") + 1 - F.countDistinct("_s"), F.count_if(F.col("g") > 1), F.max(F.col("g") - 1).cast("long"), F.count_if(F.col("close") > F.col("high")))
    got = S.quality(bars).select("symbol", "bars", "duplicates", "missing", "gaps", "largest_gap", "out_of_bounds")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert S.quality(bars.limit(0)).count() == 0


def test_a_bar_that_reaches_the_next_day_is_quarantined(spark):
    hour = 3_600_000
    rows = [("a", h * hour, (h + 1) * hour - 1 + late, 1.0, 2.0, 0.5, 1.5, 1.0, 1, 0.5) for h, late in ((22, 0), (23, 3000), (24, 0), (47, 3000), (49, 0))]
    bars = spark.createDataFrame(rows, "symbol string, open_time long, close_time long, open double, high double, low double, close double, volume double, trades long, taker_volume double")
    got = {r["open_time"] // hour: r["reasons"] for r in S.quarantine(bars).collect()}
    assert got == {22: [], 23: ["overlaps_next"], 24: [], 47: [], 49: []}
    assert S.quarantine(bars).columns == [*bars.columns, "reasons"]
    assert S.quarantine(bars.withColumn("symbol", F.lit(None).cast("string"))).count() == 5


def test_reports_keep_quotes_commas_line_ends_and_missing_values(spark, tmp_path):
    rows = [("a", 'x, "y"\nz\\'), ("b", None), ("c", '"')]
    for kind in ("csv", "json", "parquet"):
        path = str(tmp_path / kind)
        for row in rows:
            S.write_report(spark.createDataFrame([row], "k string, v string"), path, kind)
        assert sorted(map(tuple, S.read_report(spark, path, "k string, v string", kind).collect())) == rows
