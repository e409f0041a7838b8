"""Registration of queries, and the panels that the given tables provide, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import panel as P
from panelwright.sources.tables import stored

#: Added before rounding, so that values which end in exactly half a unit round alike in both engines.
NUDGE = 1.37e-8


def tidy(x: Column, digits: int) -> Column:
    return F.round(x.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)


def tidy_sql(x: str, digits: int) -> str:
    return f"round(CAST({x} AS DOUBLE) + CAST({NUDGE} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)"


FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    """Registers a function as query ``name``; ``rounded`` names its doubles, rounded alike in Spark and in the oracle."""
    columns = rounded.split()

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: tidy(F.col(c), digits) for c in columns})

        run.__name__, run.__doc__ = name, f.__doc__
        replaced = ", ".join(f"{tidy_sql(c, digits)} AS {c}" for c in columns)
        FOUND[name] = (run, sql and (f"SELECT * REPLACE ({replaced}) FROM ({sql.strip()})" if columns else sql.strip()))
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type."""
    return P.bars(table(spark, sf_dir, "events"), F.col("event_type"))


EV_BARS = """ev_bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume, count(*) AS trades
  FROM (SELECT event_type, events.ts, value FROM events) GROUP BY 1, 2)"""


def ev_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dense(ev_bars(spark, sf_dir))


EV_GRID = f"""{EV_BARS}, ev_grid AS (
  SELECT g.symbol, g.ts, open, high, low, close, volume, trades, b.ts IS NOT NULL AS present
  FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM ev_bars GROUP BY symbol) g LEFT JOIN ev_bars b ON g.symbol = b.symbol AND g.ts = b.ts)"""


def user_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve groups of users at every hour; with many gaps."""
    events = table(spark, sf_dir, "events")
    return P.universe(P.bars(events, F.concat(F.lit("u"), (F.col("user_id") % 12).cast("string"))))


USER_UNIVERSE = """us_bars AS (
  SELECT 'u' || CAST(user_id % 12 AS VARCHAR) AS symbol, date_trunc('hour', e.ts) AS ts, arg_min(value, e.ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, e.ts) AS close, sum(value) AS volume, count(*) AS trades
  FROM events e GROUP BY 1, 2),
us_uni AS (
  SELECT s.symbol, t.ts, open, high, low, close, volume, trades, b.ts IS NOT NULL AS eligible
  FROM (SELECT DISTINCT symbol FROM us_bars) s CROSS JOIN (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM us_bars) t
  LEFT JOIN us_bars b ON s.symbol = b.symbol AND t.ts = b.ts)"""


def nation_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and volumes per customer nation and week, with three factors and a dense grid; the bars are made once and written."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    nations = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(nations, F.col("o_custkey") == F.col("c_custkey"))
    weekly = stored(sold.groupBy(F.concat(F.lit("n"), F.col("c_nationkey")).alias("symbol"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        tidy(F.avg("l_extendedprice"), 4).alias("open"), tidy(F.sum("l_extendedprice") / F.sum("l_quantity"), 4).alias("close"),
        F.sum("l_quantity").alias("volume"), F.count("*").alias("trades"),
    ))
    grid = P.universe(weekly, step="INTERVAL 7 DAY")
    from panelwright.functions import window as T

    w = T.series()
    return grid.withColumns({
        "momentum": tidy(T.ts_return(F.col("close"), 1, w), 6), "activity": F.col("trades").cast("double"), "reversal": tidy(-T.ts_delta(F.col("close"), 2, w), 4),
    })


NATION_WEEK = f"""nw_bars AS (
  SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS symbol, date_trunc('week', l_shipdate) AS ts, {tidy_sql("avg(l_extendedprice)", 4)} AS open, {tidy_sql("sum(l_extendedprice) / sum(l_quantity)", 4)} AS close, sum(l_quantity) AS volume, count(*) AS trades
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
nw_uni AS (
  SELECT s.symbol, t.ts, open, close, volume, trades, b.ts IS NOT NULL AS eligible
  FROM (SELECT DISTINCT symbol FROM nw_bars) s CROSS JOIN (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 7 DAY)) AS ts FROM nw_bars) t
  LEFT JOIN nw_bars b ON s.symbol = b.symbol AND t.ts = b.ts),
nw AS (
  SELECT *, {tidy_sql("close / nullif(lag(close, 1) OVER w, 0) - 1", 6)} AS momentum, CAST(trades AS DOUBLE) AS activity, {tidy_sql("-(close - lag(close, 2) OVER w)", 4)} AS reversal
  FROM nw_uni WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def avg_rank_sql(x: str, keys: str) -> str:
    """Average rank of ``x`` within ``keys`` among rows that have it, as a SQL expression."""
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {keys}, {x} IS NOT NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x} IS NOT NULL, {x}) - 1) / 2.0::DOUBLE END"


def wilder_sql(source: str, x: str, keys: str, n: int) -> str:
    """CTEs: Wilder's index of ``x`` along each key's rows as the recursion that defines it; a NULL starts it anew. Ends with ``wilder``."""
    names = [k.strip() for k in keys.split(",")]
    same = " AND ".join(f"r.{k} = f.{k}" for k in names)
    of = lambda p: ", ".join(f"{p}.{k}" for k in names)

    def step(mean: str, move: str) -> str:
        return f"CASE WHEN r.x IS NULL OR f.x IS NULL THEN 0 WHEN f.seen + 1 <= {n} THEN f.{mean} + greatest({move}, 0) / {n} ELSE f.{mean} + (greatest({move}, 0) - f.{mean}) / {n} END"

    return f"""wr AS (SELECT {keys}, ts, {x} AS x, row_number() OVER (PARTITION BY {keys} ORDER BY ts) AS k FROM {source}),
wf AS (
  SELECT {keys}, ts, k, x, CAST(0 AS BIGINT) AS seen, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss FROM wr WHERE k = 1
  UNION ALL
  SELECT {of("r")}, r.ts, r.k, r.x, CASE WHEN r.x IS NULL OR f.x IS NULL THEN 0 ELSE f.seen + 1 END, {step("gain", "r.x - f.x")}, {step("loss", "f.x - r.x")}
  FROM wf f JOIN wr r ON {same} AND r.k = f.k + 1),
wilder AS (SELECT {keys}, ts, CASE WHEN x IS NULL OR seen < {n} THEN NULL WHEN gain + loss = 0 THEN 50 ELSE 100 * gain / (gain + loss) END AS rsi FROM wf)"""
