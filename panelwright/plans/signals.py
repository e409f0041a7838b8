"""Signal rules and performance tables (G), over nations' weekly closes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import signals as G
from panelwright.plans.base import EV_BARS, NATION_WEEK, ev_bars, nation_week, query
from panelwright.sources.tables import stored

_RULES = {
    "hold": G.buy_and_hold, "trend": partial(G.sma_trend, n=20), "momentum": partial(G.momentum, n=13), "breakout": partial(G.donchian, entry=13, leave=6),
    "reversion": partial(G.mean_reversion, n=13, entry=1.0), "vol_target": partial(G.vol_target, n=13, target=0.5, cap=1.5, periods_per_year=52.0),
}


def _frame(name: str, n: int, first: int = 0) -> str:
    return f"{name} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + first} PRECEDING AND {f'{first} PRECEDING' if first else 'CURRENT ROW'})"


_SIGNALS = f"""{NATION_WEEK}, g0 AS (SELECT symbol, ts, close, close / nullif(lag(close) OVER w, 0) - 1 AS r, CASE WHEN count(close) OVER d20 = 20 THEN avg(close) OVER d20 END AS sma, close / nullif(lag(close, 13) OVER w, 0) - 1 AS m, CASE WHEN count(close) OVER u13 = 13 THEN max(close) OVER u13 END AS up, CASE WHEN count(close) OVER l6 = 6 THEN min(close) OVER l6 END AS lo,
  CASE WHEN count(close) OVER d13 = 13 AND stddev_pop(close) OVER d13 > 0 THEN (close - avg(close) OVER d13) / stddev_pop(close) OVER d13 END AS z FROM nw WINDOW w AS (PARTITION BY symbol ORDER BY ts), {_frame("d20", 20)}, {_frame("d13", 13)}, {_frame("u13", 13, 1)}, {_frame("l6", 6, 1)}),
g1 AS (SELECT *, CASE WHEN count(r) OVER d13 = 13 THEN stddev_pop(r) OVER d13 * sqrt(52.0::DOUBLE) END AS vol, CASE WHEN close >= up THEN 1.0::DOUBLE WHEN close <= lo THEN 0.0::DOUBLE END AS t_b, CASE WHEN z <= -1 THEN 1.0::DOUBLE WHEN z >= 0 THEN 0.0::DOUBLE END AS t_r FROM g0 WINDOW {_frame("d13", 13)}),
sg AS (SELECT symbol, ts, close, 'hold' AS strategy, 1.0::DOUBLE AS weight FROM g1 UNION ALL SELECT symbol, ts, close, 'trend', coalesce((close > sma)::INT::DOUBLE, 0) FROM g1 UNION ALL SELECT symbol, ts, close, 'momentum', coalesce((m > 0)::INT::DOUBLE, 0) FROM g1
  UNION ALL SELECT symbol, ts, close, 'breakout', coalesce(last_value(t_b IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) FROM g1 UNION ALL SELECT symbol, ts, close, 'reversion', coalesce(last_value(t_r IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) FROM g1
  UNION ALL SELECT symbol, ts, close, 'vol_target', coalesce(sign(m) * least(CASE WHEN vol > 0 THEN 0.5 / vol END, CASE WHEN vol IS NOT NULL OR vol IS NULL THEN 1.5::DOUBLE END), 0) FROM g1)"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.run_rules(stored(nation_week(spark, sf_dir).select("symbol", "ts", "close")), _RULES)


@query("g_signal_rules", f"WITH {_SIGNALS} SELECT * FROM sg", "close weight")
def g_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six named rules over all symbols, latches included."""
    return _weighted(spark, sf_dir).select("symbol", "ts", "close", "strategy", "weight")


_PATH = f"""{_SIGNALS}, h0 AS (SELECT *, coalesce(lag(weight) OVER w, 0) AS held, coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS benchmark FROM sg WINDOW w AS (PARTITION BY strategy, symbol ORDER BY ts)), h1 AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY strategy, symbol ORDER BY ts), 0)) AS turnover FROM h0),
h2 AS (SELECT *, held * benchmark - turnover * 0.0005::DOUBLE AS net FROM h1), h3 AS (SELECT *, CASE WHEN min(net + 1) OVER w > 0 THEN exp(sum(CASE WHEN net > -1 THEN ln(1 + net) END) OVER w) END AS equity FROM h2 WINDOW w AS (PARTITION BY strategy, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
pt AS (SELECT symbol, ts, strategy, held, benchmark, turnover, net, equity, equity / greatest(max(equity) OVER (PARTITION BY strategy, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 1) - 1 AS drawdown FROM h3)"""


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.returns(_weighted(spark, sf_dir), 0.0005).select("symbol", "ts", "strategy", "held", "benchmark", "turnover", "net", "equity", "drawdown")


@query("g_return_path", f"WITH {_PATH} SELECT symbol, ts, strategy, held, benchmark, turnover, net, ln(equity) AS log_equity, drawdown FROM pt", "held benchmark turnover net log_equity drawdown", 5)
def g_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-bar returns of the weights, cost, equity (its log, as it spans many orders) and drawdown."""
    return _path(spark, sf_dir).withColumn("log_equity", F.ln("equity")).drop("equity")


@query("g_monthly_distribution", f"WITH {_PATH}, e AS (SELECT strategy, symbol, date_trunc('month', ts) AS m, arg_max_null(equity, ts) AS eq FROM pt GROUP BY 1, 2, 3), r AS (SELECT strategy, symbol, round(eq / nullif(lag(eq) OVER (PARTITION BY strategy, symbol ORDER BY m), 0) - 1, 9) AS r FROM e) SELECT strategy, symbol, count(r) AS months, avg(r) AS mean, stddev_samp(r) AS std, max(r) AS best, min(r) AS worst, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.95) AS p95, avg(CASE WHEN r IS NOT NULL THEN (r > 0)::INT END) AS positive_share FROM r GROUP BY 1, 2", "mean std best worst p05 p50 p95 positive_share", 5)
def g_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of monthly returns."""
    return G.monthly(_path(spark, sf_dir), ["strategy", "symbol"])


@query("g_losing_streaks", f"WITH {_PATH}, r AS (SELECT *, sum((net >= 0)::INT) OVER (PARTITION BY strategy, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM pt), s AS (SELECT strategy, symbol, run, count(*) AS n, sum(net) AS lost FROM r WHERE net < 0 GROUP BY 1, 2, 3) SELECT k.strategy, k.symbol, coalesce(max(n), 0) AS longest, coalesce(min(lost), 0) AS worst FROM (SELECT DISTINCT strategy, symbol FROM pt) k LEFT JOIN s ON s.strategy = k.strategy AND s.symbol = k.symbol GROUP BY 1, 2", "worst")
def g_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest losing streak and the worst one's sum."""
    return G.losing_streaks(_path(spark, sf_dir), ["strategy", "symbol"])


def _log(growth: Column | str) -> Column:
    """Growth as a log, NULL kept, a total loss as the log of 1e-12."""
    x = F.col(growth) if isinstance(growth, str) else growth
    return F.when(x.isNotNull(), F.ln(F.greatest(x + 1, F.lit(1e-12))))


_SPANS = {"whole": ("1992-01-01", "2010-01-01"), "train": ("1992-01-01", "1998-01-05"), "test": ("1998-01-05", "2010-01-01")}
_PERFORMANCE = f"""{_PATH}, v AS (SELECT pt.*, s.name AS span FROM pt JOIN (VALUES {", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, (a, b) in _SPANS.items())}) s(name, a, b) ON ts >= s.a AND ts < s.b),
v1 AS (SELECT *, sum(CASE WHEN net > -1 THEN ln(1 + net) END) OVER (PARTITION BY strategy, symbol, span ORDER BY ts ROWS UNBOUNDED PRECEDING) AS gl FROM v), v2 AS (SELECT *, exp(gl - greatest(max(gl) OVER (PARTITION BY strategy, symbol, span ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)) - 1 AS down FROM v1),
v3 AS (SELECT strategy, symbol, span, count(*) AS bars, CASE WHEN min(net) > -1 THEN exp(avg(CASE WHEN net > -1 THEN ln(1 + net) END) * 52) - 1 END AS cagr, stddev_samp(net) * sqrt(52.0::DOUBLE) AS vol, avg(net) * 52 AS mean, sqrt(avg(pow(least(net, 0), 2))) * sqrt(52.0::DOUBLE) AS ds, min(down) AS max_drawdown, avg((net > 0)::INT) AS win_rate, avg(net) FILTER (net > 0) / nullif(-avg(net) FILTER (net < 0), 0) AS payoff, sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net < 0), 0) AS profit_factor,
  sum(turnover) AS turnover, quantile_cont(abs(held), 0.95) AS participation_p95, exp(sum(CASE WHEN benchmark > -1 THEN ln(1 + benchmark) END)) - 1 AS benchmark, exp(sum(CASE WHEN net > -1 THEN ln(1 + net) END)) - 1 AS total FROM v2 GROUP BY 1, 2, 3),
pf AS (SELECT strategy, symbol, span, bars, cagr, vol, max_drawdown, win_rate, payoff, profit_factor, turnover, participation_p95, benchmark, total, mean / CASE WHEN vol > 1e-12 THEN vol END AS sharpe, mean / CASE WHEN ds > 1e-12 THEN ds END AS sortino, cagr / CASE WHEN max_drawdown < -1e-12 THEN -max_drawdown END AS calmar, total - benchmark AS excess FROM v3)"""


def _performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.performance(_path(spark, sf_dir), _SPANS, 52.0, ["strategy", "symbol"]).withColumnRenamed("window", "span")


@query("g_performance_summary", f"WITH {_PERFORMANCE} SELECT * REPLACE (CASE WHEN cagr IS NOT NULL THEN ln(greatest(1 + cagr, 1e-12)) END AS cagr, ln(greatest(1 + benchmark, 1e-12)) AS benchmark, ln(greatest(1 + total, 1e-12)) AS total, sign(excess) * ln(1 + abs(excess)) AS excess, sign(calmar) * ln(1 + abs(calmar)) AS calmar) FROM pf", "cagr vol max_drawdown win_rate payoff profit_factor turnover participation_p95 benchmark total sharpe sortino calmar excess", 4)
def g_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios, wins, turnover, benchmark and excess over three windows; growth in logs, as it spans many orders (with its sign where it has one)."""
    signed = lambda c: F.signum(c) * F.log1p(F.abs(c))
    return _performance(spark, sf_dir).withColumns({"cagr": _log("cagr"), "benchmark": _log("benchmark"), "total": _log("total"), "excess": signed("excess"), "calmar": signed("calmar")})


@query("g_risk_gate", f"WITH {_PERFORMANCE}, f AS (SELECT strategy, symbol, span, concat_ws(',', CASE WHEN NOT coalesce(round(sharpe, 6) >= 0.0, false) THEN 'sharpe' END, CASE WHEN NOT coalesce(round(max_drawdown, 6) >= -0.9, false) THEN 'max_drawdown' END, CASE WHEN NOT coalesce(bars >= 100, false) THEN 'bars' END) AS failed FROM pf) SELECT *, failed = '' AS passed, min((failed = '')::INT) OVER (PARTITION BY strategy, span) = 1 AS all_passed FROM f")
def g_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that fail, and whether all symbols of a strategy pass."""
    p = _performance(spark, sf_dir).withColumns({"sharpe": F.round("sharpe", 6), "max_drawdown": F.round("max_drawdown", 6)})
    return G.risk_gate(p, {"sharpe": (">=", 0.0), "max_drawdown": (">=", -0.9), "bars": (">=", 100)}, ["strategy", "span"]).select("strategy", "symbol", "span", "failed", "passed", "all_passed")


@query("g_strategy_pivot", f"WITH {_PERFORMANCE} SELECT symbol, strategy, ln(greatest(1 + max(total) FILTER (span = 'whole'), 1e-12)) AS whole, ln(greatest(1 + max(total) FILTER (span = 'train'), 1e-12)) AS train, ln(greatest(1 + max(total) FILTER (span = 'test'), 1e-12)) AS test FROM pf GROUP BY 1, 2", "whole train test", 4)
def g_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total return per symbol, strategy and window, as a pivot."""
    return _performance(spark, sf_dir).groupBy("symbol", "strategy").pivot("span", ["whole", "train", "test"]).agg(_log(F.max("total")))


_GROWTH = f"""{_PATH}, c AS (SELECT *, sum(CASE WHEN net > -1 THEN ln(1 + net) END) OVER w AS gn, sum(CASE WHEN benchmark > -1 THEN ln(1 + benchmark) END) OVER w AS gb, sum((net <= -1)::INT) OVER w AS lost FROM pt WINDOW w AS (PARTITION BY strategy, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
sp(span, a, b) AS (VALUES {", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, (a, b) in _SPANS.items())}),
wi AS (SELECT strategy, symbol, span, any_value(a) AS a, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, sum(turnover) AS turnover FROM c JOIN sp ON ts >= a AND ts < b GROUP BY 1, 2, 3),
an AS (SELECT wi.*, (SELECT max(ts) FROM pt WHERE pt.strategy = wi.strategy AND pt.symbol = wi.symbol AND ts < wi.a) AS before_ts FROM wi),
gr AS (SELECT an.strategy, an.symbol, span, bars, x.ts AS anchor_ts, y.ts AS last_ts, nullif((epoch(y.ts) - epoch(x.ts)) / (365.0::DOUBLE * 86400), 0) AS years, CASE WHEN y.lost = x.lost THEN coalesce(y.gn, 0) - coalesce(x.gn, 0) END AS log_growth, coalesce(y.gb, 0) - coalesce(x.gb, 0) AS log_benchmark, an.turnover
  FROM an JOIN c x ON x.strategy = an.strategy AND x.symbol = an.symbol AND x.ts = coalesce(before_ts, first_ts) JOIN c y ON y.strategy = an.strategy AND y.symbol = an.symbol AND y.ts = an.last_ts)"""


@query("g_window_growth", f"WITH {_GROWTH} SELECT strategy, symbol, span, bars, anchor_ts, last_ts, years, log_growth, log_growth / years AS log_cagr, log_benchmark, turnover / years AS turnover_a_year FROM gr", "years log_growth log_cagr log_benchmark turnover_a_year", 4)
def g_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of each window from the bar before it, in logs, by years between both ends."""
    return G.window_growth(_path(spark, sf_dir), _SPANS, ["strategy", "symbol"]).withColumnRenamed("window", "span")


@query("g_bar_spacing", f"WITH {EV_BARS}, g AS (SELECT symbol, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 3600 AS h FROM ev_bars) SELECT symbol, median(h) AS hours, 8760.0::DOUBLE / median(h) AS bars_per_year FROM g GROUP BY symbol", "hours bars_per_year")
def g_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed spacing of bars."""
    return G.spacing(ev_bars(spark, sf_dir))
