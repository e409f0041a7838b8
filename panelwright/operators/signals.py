"""Signal rules on bars, and performance tables of the weights they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions import window as T
from panelwright.functions.pointwise import div
from panelwright.operators import scan


def _latch(df: DataFrame, enter: Column, leave: Column, keys: list[str]) -> Column:
    """1 from the last entry on, 0 from the last exit on, 0 before either."""
    trigger = F.when(enter, 1.0).when(leave, 0.0)
    return F.coalesce(F.last(trigger, True).over(W.partitionBy(*keys).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))


def buy_and_hold(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.lit(1.0))


def sma_trend(df: DataFrame, n: int) -> DataFrame:
    """1 while the close is above its mean of ``n``."""
    return df.withColumn("weight", F.coalesce((F.col("close") > T.ts_mean(F.col("close"), n, T.series())).cast("double"), F.lit(0.0)))


def momentum(df: DataFrame, n: int, threshold: float = 0.0) -> DataFrame:
    """1 while the return over ``n`` is above a threshold."""
    return df.withColumn("weight", F.coalesce((T.ts_return(F.col("close"), n, T.series()) > threshold).cast("double"), F.lit(0.0)))


def donchian(df: DataFrame, entry: int, leave: int) -> DataFrame:
    """In from a close at the upper bound on, out from one at the lower bound on."""
    w = T.series()
    upper, _ = T.previous_donchian(F.col("close"), F.col("close"), entry, w)
    _, lower = T.previous_donchian(F.col("close"), F.col("close"), leave, w)
    bound = df.withColumns({"_u": upper, "_l": lower})
    return bound.withColumn("weight", _latch(bound, F.col("close") >= F.col("_u"), F.col("close") <= F.col("_l"), ["symbol"])).drop("_u", "_l")


def mean_reversion(df: DataFrame, n: int, entry: float) -> DataFrame:
    """In from a z score of minus ``entry`` on, out from zero on."""
    z = df.withColumn("_z", T.zscore(F.col("close"), n, T.series()))
    return z.withColumn("weight", _latch(z, F.col("_z") <= -entry, F.col("_z") >= 0, ["symbol"])).drop("_z")


def vol_target(df: DataFrame, n: int, target: float, cap: float, periods_per_year: float) -> DataFrame:
    """The trend's sign times target over realised volatility, up to a cap."""
    w = T.series()
    moved = df.withColumns({"_r": T.ts_return(F.col("close"), 1, w), "_t": F.signum(T.ts_return(F.col("close"), n, w))})
    vol = moved.withColumn("_v", T.ts_std(F.col("_r"), n, w) * periods_per_year**0.5)
    return vol.withColumn("weight", F.coalesce(F.col("_t") * F.least(div(F.lit(target), F.when(F.col("_v") > 0, F.col("_v"))), F.lit(cap)), F.lit(0.0))).drop("_r", "_t", "_v")


def run_rules(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """All rules over all symbols, one table keyed by ``strategy``."""
    out = None
    for name, rule in rules.items():
        made = rule(df).withColumn("strategy", F.lit(name))
        out = made if out is None else out.unionByName(made)
    return out


def returns(weighted: DataFrame, cost: float) -> DataFrame:
    """Per strategy, symbol and bar: the return of the weight set one bar before, less the cost of changing it, and the benchmark's."""
    w = W.partitionBy("strategy", "symbol").orderBy("ts")
    moved = weighted.withColumns({"held": F.coalesce(F.lag("weight").over(w), F.lit(0.0)), "benchmark": F.coalesce(div(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0))})
    moved = moved.withColumn("turnover", F.abs(F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0))))
    made = moved.withColumn("net", F.col("held") * F.col("benchmark") - F.col("turnover") * cost)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    grows = F.min(F.col("net") + 1).over(run) > 0
    made = made.withColumn("equity", F.when(grows, F.exp(F.sum(F.when(F.col("net") > -1, F.log1p("net"))).over(run))))
    return made.withColumn("drawdown", F.col("equity") / F.greatest(F.max("equity").over(run), F.lit(1.0)) - 1)


def monthly(path: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the distribution of month-end to month-end returns, to nine decimals, so that an unchanged equity is no gain."""
    ends = path.groupBy(*keys, F.date_trunc("month", "ts").alias("month")).agg(F.max_by("equity", "ts").alias("equity"))
    made = ends.withColumn("r", F.round(div(F.col("equity"), F.lag("equity").over(W.partitionBy(*keys).orderBy("month"))) - 1, 9))
    q = lambda p, n: F.expr(f"percentile(r, {p})").alias(n)
    return made.groupBy(*keys).agg(F.count("r").alias("months"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.max("r").alias("best"), F.min("r").alias("worst"), q(0.05, "p05"), q(0.5, "p50"), q(0.95, "p95"), F.avg((F.col("r") > 0).cast("int")).alias("positive_share"))


def losing_streaks(path: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the longest run of losing bars and the worst sum of a run."""
    w = W.partitionBy(*keys).orderBy("ts")
    runs = path.withColumn("_run", F.sum((F.col("net") >= 0).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    each = runs.where("net < 0").groupBy(*keys, "_run").agg(F.count("*").alias("n"), F.sum("net").alias("lost"))
    none = path.select(*keys).distinct()
    return none.join(each.groupBy(*keys).agg(F.max("n").alias("longest"), F.min("lost").alias("worst")), keys, "left").withColumns({"longest": F.coalesce("longest", F.lit(0)), "worst": F.coalesce("worst", F.lit(0.0))})


def performance(path: DataFrame, windows: dict[str, tuple[str, str]], periods_per_year: float, keys: list[str]) -> DataFrame:
    """Per key and window: growth, volatility, Sharpe, Sortino and Calmar ratios, wins, turnover, benchmark, excess."""
    spans = [F.struct(F.lit(n).alias("window"), F.expr(f"TIMESTAMP_NTZ '{a}'").alias("start"), F.expr(f"TIMESTAMP_NTZ '{b}'").alias("stop")) for n, (a, b) in windows.items()]
    seen = path.withColumn("_w", F.explode(F.array(*spans))).where("ts >= _w.start AND ts < _w.stop").withColumn("window", F.col("_w.window"))
    at = [*keys, "window"]
    run = W.partitionBy(*at).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    seen = seen.withColumn("_g", F.sum(F.when(F.col("net") > -1, F.log1p("net"))).over(run))
    seen = seen.withColumn("_down", F.exp(F.col("_g") - F.greatest(F.max("_g").over(run), F.lit(0.0))) - 1)
    win, loss = F.col("net") > 0, F.col("net") < 0
    made = seen.groupBy(*at).agg(
        F.count("*").alias("bars"), F.when(F.min("net") > -1, F.exp(F.avg(F.log1p("net")) * periods_per_year) - 1).alias("cagr"), (F.stddev_samp("net") * periods_per_year**0.5).alias("vol"),
        (F.avg("net") * periods_per_year).alias("_mean"), (F.sqrt(F.avg(F.pow(F.least("net", F.lit(0.0)), F.lit(2.0)))) * periods_per_year**0.5).alias("_downside"), F.min("_down").alias("max_drawdown"),
        F.avg(win.cast("int")).alias("win_rate"), div(F.avg(F.when(win, F.col("net"))), -F.avg(F.when(loss, F.col("net")))).alias("payoff"), div(F.sum(F.when(win, F.col("net"))), -F.sum(F.when(loss, F.col("net")))).alias("profit_factor"),
        F.sum("turnover").alias("turnover"), F.expr("percentile(abs(held), 0.95)").alias("participation_p95"), (F.exp(F.sum(F.when(F.col("benchmark") > -1, F.log1p("benchmark")))) - 1).alias("benchmark"), (F.exp(F.sum(F.when(F.col("net") > -1, F.log1p("net")))) - 1).alias("total"),
    )
    above = lambda c: F.when(F.col(c) > 1e-12, F.col(c))
    return made.withColumns({"sharpe": div(F.col("_mean"), above("vol")), "sortino": div(F.col("_mean"), above("_downside")), "calmar": div(F.col("cagr"), F.when(F.col("max_drawdown") < -1e-12, -F.col("max_drawdown"))), "excess": F.col("total") - F.col("benchmark")}).drop("_mean", "_downside")


def window_growth(path: DataFrame, windows: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """Per key and window: growth from the anchor, the last bar before the window, to the window's last bar, in logs and per year of 365 days.

    The anchor's equity earns the window's first return; a window that the path begins in has its
    first bar as anchor, whose own return then doesn't count. ``log_cagr`` is the log of last over
    anchor by years; NULL after a total loss, or where the window has one bar and no anchor.
    Turnover is of the window's bars, by year.
    """
    over = lambda c: ("sum", F.when(F.col(c) > -1, F.log1p(c)))
    totals = scan.running(
        scan.bucketed(path.select(*keys, "ts", "net", "benchmark", "turnover"), keys, "ts", "year"), keys, ["ts"],
        _net=over("net"), _benchmark=over("benchmark"), _lost=("sum", (F.col("net") <= -1).cast("int")),
    )
    spans = [F.struct(F.lit(n).alias("window"), F.expr(f"TIMESTAMP_NTZ '{a}'").alias("start"), F.expr(f"TIMESTAMP_NTZ '{b}'").alias("stop")) for n, (a, b) in windows.items()]
    seen = totals.withColumn("_w", F.explode(F.array(*spans))).where("ts < _w.stop").withColumn("state", F.struct("ts", "_net", "_benchmark", "_lost"))
    inside = F.col("ts") >= F.col("_w.start")
    at = lambda pick, when: pick(F.when(when, F.col("state")), F.when(when, F.col("ts")))
    made = seen.groupBy(*keys, F.col("_w.window").alias("window")).agg(
        F.count_if(inside).alias("bars"), at(F.max_by, ~inside).alias("before"), at(F.min_by, inside).alias("first"), at(F.max_by, inside).alias("last"), F.sum(F.when(inside, F.col("turnover"))).alias("turnover"),
    ).where("bars > 0").withColumn("anchor", F.coalesce("before", "first"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    years = F.when(F.col("last.ts") > F.col("anchor.ts"), (seconds("last.ts") - seconds("anchor.ts")) / (365.0 * 24 * 3600))
    sound = F.col("last._lost") == F.col("anchor._lost")
    growth = {"log_growth": F.when(sound, F.col("last._net") - F.col("anchor._net")), "log_benchmark": F.col("last._benchmark") - F.col("anchor._benchmark")}
    made = made.withColumns({"anchor_ts": F.col("anchor.ts"), "last_ts": F.col("last.ts"), "years": years, **growth})
    made = made.withColumns({"log_cagr": div(F.col("log_growth"), F.col("years")), "turnover_a_year": div(F.col("turnover"), F.col("years"))})
    return made.select(*keys, "window", "bars", "anchor_ts", "last_ts", "years", "log_growth", "log_cagr", "log_benchmark", "turnover_a_year")


def risk_gate(table: DataFrame, bounds: dict[str, tuple[str, float]], keys: list[str]) -> DataFrame:
    """``table`` with ``failed`` checks and ``passed``, and whether all rows of a key pass."""
    checks = [F.when(~F.coalesce(F.col(c) >= v if op == ">=" else F.col(c) <= v, F.lit(False)), c) for c, (op, v) in bounds.items()]
    made = table.withColumn("failed", F.concat_ws(",", *checks)).withColumn("passed", F.col("failed") == "")
    return made.withColumn("all_passed", F.min(F.col("passed").cast("int")).over(W.partitionBy(*keys)) == 1)


def spacing(df: DataFrame) -> DataFrame:
    """Per symbol: the median spacing of bars in hours and bars per year of 365 days."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    gaps = df.withColumn("_h", (s - F.lag(s).over(T.series())) / 3600)
    return gaps.groupBy("symbol").agg(F.median("_h").alias("hours")).withColumn("bars_per_year", div(F.lit(365.0 * 24), F.col("hours")))
