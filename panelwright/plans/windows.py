"""Rolling operators (T) and cross-section operators (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import cross as C
from panelwright.functions import window as T
from panelwright.plans.base import EV_BARS, EV_GRID, NATION_WEEK, USER_UNIVERSE, avg_rank_sql, ev_bars, ev_grid, nation_week, query, user_universe, wilder_sql

_T = "t_delay t_delta t_return t_mean t_sum t_min t_max t_std t_cov t_corr t_rank"
_W4 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"


@query(
    "t_rolling_operators",
    f"""WITH {EV_GRID}, p AS (SELECT symbol, ts, close AS x, CASE WHEN close IS NOT NULL THEN volume END AS y FROM ev_grid)
SELECT symbol, ts, lag(x, 3) OVER w AS t_delay, x - lag(x, 3) OVER w AS t_delta, x / nullif(lag(x, 3) OVER w, 0) - 1 AS t_return,
  CASE WHEN count(x) OVER d = 4 THEN avg(x) OVER d END AS t_mean, CASE WHEN count(x) OVER d = 4 THEN sum(x) OVER d END AS t_sum, CASE WHEN count(x) OVER d = 4 THEN min(x) OVER d END AS t_min,
  CASE WHEN count(x) OVER d = 4 THEN max(x) OVER d END AS t_max, CASE WHEN count(x) OVER d = 4 THEN stddev_pop(x) OVER d END AS t_std, CASE WHEN count(x) OVER d = 4 THEN covar_pop(x, y) OVER d END AS t_cov,
  CASE WHEN count(x) OVER d = 4 AND min(x) OVER d < max(x) OVER d AND min(y) OVER d < max(y) OVER d THEN covar_pop(x, y) OVER d / (stddev_pop(x) OVER d * stddev_pop(y) OVER d) END AS t_corr,
  CASE WHEN count(x) OVER d = 4 THEN (len(list_filter(list(x) OVER d, lambda v: v < x)) + (len(list_filter(list(x) OVER d, lambda v: v = x)) + 1) / 2.0::DOUBLE - 1) / 3 END AS t_rank
FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts), d AS {_W4}""",
    _T,
    5,
)
def t_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T3, T5-T12 over four hours of each event type."""
    w, x, y = T.series(), F.col("close"), F.col("volume")
    made = [T.ts_delay(x, 3, w), T.ts_delta(x, 3, w), T.ts_return(x, 3, w), *(f(x, 4, w) for f in (T.ts_mean, T.ts_sum, T.ts_min, T.ts_max, T.ts_std)), T.ts_cov(x, y, 4, w), T.ts_corr(x, y, 4, w), T.ts_rank(x, 4, w)]
    return ev_grid(spark, sf_dir).select("symbol", "ts", *[c.alias(n) for c, n in zip(made, _T.split(), strict=True)])


@query("t_wilder_rsi", f"WITH RECURSIVE {EV_GRID}, {wilder_sql('ev_grid', 'close', 'symbol', 14)} SELECT symbol, ts, rsi FROM wilder", "rsi")
def t_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: Wilder's relative strength index over 14 changes of each event type's hours; a missing hour starts it anew."""
    return T.ts_rsi(ev_grid(spark, sf_dir), "close", 14).select("symbol", "ts", "rsi")


@query(
    "t_indicators",
    f"""WITH {NATION_WEEK}, p AS (SELECT symbol, ts, close, coalesce(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1, 0) AS ret FROM nw)
SELECT symbol, ts, CASE WHEN count(close) OVER d = 8 THEN avg(close) OVER d END AS sma, ret, CASE WHEN count(ret) OVER d = 8 THEN stddev_pop(ret) OVER d * sqrt(52.0::DOUBLE) END AS realized,
  CASE WHEN count(close) OVER d = 8 AND stddev_pop(close) OVER d > 0 THEN (close - avg(close) OVER d) / stddev_pop(close) OVER d END AS zscore,
  CASE WHEN count(close) OVER e = 8 THEN max(close) OVER e END AS upper, CASE WHEN count(close) OVER e = 8 THEN min(close) OVER e END AS lower
FROM p WINDOW d AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), e AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""",
    "sma ret realized zscore upper lower",
    5,
)
def t_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving average, simple returns (0 for the first), realised volatility, z score, Donchian bounds."""
    w, close = T.series(), F.col("close")
    p = nation_week(spark, sf_dir).select("symbol", "ts", "close").withColumn("ret", F.coalesce(T.ts_return(close, 1, w), F.lit(0.0)))
    upper, lower = T.previous_donchian(close, close, 8, w)
    realized = T.ts_std(F.col("ret"), 8, w) * F.sqrt(F.lit(52.0))
    return p.select("symbol", "ts", T.ts_mean(close, 8, w).alias("sma"), "ret", realized.alias("realized"), T.zscore(close, 8, w).alias("zscore"), upper.alias("upper"), lower.alias("lower"))


@query(
    "t_smoothed_factors",
    f"""WITH {NATION_WEEK} SELECT symbol, ts, {", ".join(f"CASE WHEN count(momentum) OVER w{n} = {n} THEN avg(momentum) OVER w{n} END AS smooth_{n}" for n in (4, 12, 24))}
FROM nw WINDOW {", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (4, 12, 24))}""",
    "smooth_4 smooth_12 smooth_24",
)
def t_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor's means over 4, 12 and 24 steps, all present."""
    w = T.series()
    return nation_week(spark, sf_dir).select("symbol", "ts", *[T.ts_mean(F.col("momentum"), n, w).alias(f"smooth_{n}") for n in (4, 12, 24)])


def _cross_sql(panel: str, source: str, x: str) -> str:
    return f"""WITH {panel}, e AS (SELECT symbol, ts, CASE WHEN eligible THEN {x} END AS x FROM {source}), r AS (SELECT *, {avg_rank_sql("x", "ts")} AS rk, count(x) OVER (PARTITION BY ts) AS n FROM e)
SELECT symbol, ts, CASE WHEN x IS NOT NULL AND n >= 2 THEN (rk - 1) / (n - 1) END AS c_rank, CASE WHEN x IS NOT NULL AND n >= 2 THEN 100 * (rk - 1) / (n - 1) END AS c_pct,
  CASE WHEN min(x) OVER (PARTITION BY ts) < max(x) OVER (PARTITION BY ts) THEN (x - avg(x) OVER (PARTITION BY ts)) / stddev_pop(x) OVER (PARTITION BY ts) END AS c_zscore, n AS members, x AS masked FROM r"""


def _cross(df: DataFrame, x: str) -> DataFrame:
    df = df.select("symbol", "ts", "eligible", F.col(x).alias("x"))
    df = C.cross_zscore(C.cross_pct(C.cross_rank(df, "x", "c_rank"), "x", "c_pct"), "x", "c_zscore")
    masked = C.masked(F.col("x"), F.col("eligible"))
    return df.select("symbol", "ts", "c_rank", "c_pct", "c_zscore", C.members(masked, "ts").alias("members"), masked.alias("masked"))


@query("c_cross_section", _cross_sql(NATION_WEEK, "nw", "momentum"), "c_rank c_pct c_zscore masked")
def c_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C5 over 25 nations a week."""
    return _cross(nation_week(spark, sf_dir), "momentum")


@query("c_cross_section_with_gaps", _cross_sql(USER_UNIVERSE, "us_uni", "close"), "c_rank c_pct c_zscore masked")
def c_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1-C5 over 12 user groups an hour, of which many are missing."""
    return _cross(user_universe(spark, sf_dir), "close")


@query(
    "c_distinct_and_spearman",
    f"""WITH {NATION_WEEK}, p AS (SELECT ts, CASE WHEN activity IS NOT NULL THEN momentum END AS x, CASE WHEN momentum IS NOT NULL THEN activity END AS y FROM nw WHERE eligible), r AS (SELECT *, {avg_rank_sql("x", "ts")} AS rx, {avg_rank_sql("y", "ts")} AS ry FROM p)
SELECT ts, count(x) AS n, count(DISTINCT x) AS distinct_x, count(DISTINCT y) AS distinct_y,
  CASE WHEN count(x) >= 3 AND count(DISTINCT x) >= 2 AND count(DISTINCT y) >= 2 THEN covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS spearman FROM r GROUP BY ts""",
    "spearman",
)
def c_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values under a mask and Spearman correlation of one pair at each time."""
    both = nation_week(spark, sf_dir).where("eligible").select("ts", F.when(F.col("activity").isNotNull(), F.col("momentum")).alias("x"), F.when(F.col("momentum").isNotNull(), F.col("activity")).alias("y"))
    ranked = both.withColumns({"rx": C.average_rank(F.col("x"), "ts"), "ry": C.average_rank(F.col("y"), "ts")})
    found = ranked.groupBy("ts").agg(F.count("x").alias("n"), F.countDistinct("x").alias("distinct_x"), F.countDistinct("y").alias("distinct_y"), C.correlation(F.col("rx"), F.col("ry")).alias("spearman"))
    enough = (F.col("n") >= 3) & (F.col("distinct_x") >= 2) & (F.col("distinct_y") >= 2)
    return found.withColumn("spearman", F.when(enough, F.col("spearman")))
