"""Pointwise operators (X), derived factors (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import pointwise as X
from panelwright.functions import window as T
from panelwright.functions.templates import NETS, templates
from panelwright.plans.base import EV_GRID, NATION_WEEK, ev_grid, nation_week, query

_NAMES = "x_add x_sub x_mul x_div x_abs x_neg x_sign x_min x_max x_log x_sqrt x_power x_bounded"


@query(
    "x_pointwise_operators",
    f"""WITH {EV_GRID}, p AS (SELECT symbol, ts, open - close AS x, CAST(trades - 2 AS DOUBLE) AS y FROM ev_grid)
SELECT symbol, ts, x + y AS x_add, x - y AS x_sub, x * y AS x_mul, x / nullif(y, 0) AS x_div, abs(x) AS x_abs, -x AS x_neg, sign(x) AS x_sign,
  CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(x, y) END AS x_min, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN greatest(x, y) END AS x_max,
  CASE WHEN x > 0 THEN ln(x) END AS x_log, CASE WHEN x >= 0 THEN sqrt(x) END AS x_sqrt, CASE WHEN y <> 0 THEN pow(y, -2.0) END AS x_power,
  (y - 1) / nullif(y + 1, 0) AS x_bounded FROM p""",
    _NAMES,
)
def x_pointwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pointwise operator on open - close and trades - 2, which have zeros, negatives and gaps."""
    p = ev_grid(spark, sf_dir).select("symbol", "ts", (F.col("open") - F.col("close")).alias("x"), (F.col("trades") - 2).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    made = [X.add(x, y), X.sub(x, y), X.mul(x, y), X.div(x, y), X.absolute(x), X.neg(x), X.sign(x), X.smaller(x, y), X.larger(x, y), X.log(x), X.sqrt(x), X.power(y, -2), X.bounded_ratio(y)]
    return p.select("symbol", "ts", *[c.alias(n) for c, n in zip(made, _NAMES.split(), strict=True)])


@query(
    "d_derived_factors",
    f"""WITH {EV_GRID}, p AS (SELECT *, close / nullif(open, 0) - 1 AS basis, CASE WHEN close > 0 THEN ln(close) END - CASE WHEN lag(close) OVER w > 0 THEN ln(lag(close) OVER w) END AS lr FROM ev_grid WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, basis, basis - lag(basis) OVER w AS basis_change, volume / nullif(lag(volume, 1) OVER w, 0) - 1 AS interest_change_1, volume / nullif(lag(volume, 24) OVER w, 0) - 1 AS interest_change_24,
  (high / nullif(low, 0) - 1) / nullif(high / nullif(low, 0) + 1, 0) AS net, close / nullif(volume, 0) AS share,
  CASE WHEN count(volume) OVER d = 24 THEN sum(volume) OVER d END AS volume_24, lr AS log_return, 0.0001::DOUBLE * trades * 24 * 365.25 / 8 AS funding_year,
  CASE WHEN count(lr) OVER d = 24 THEN stddev_pop(lr) OVER d * sqrt(24 * 365.25::DOUBLE) END AS realized_vol
FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts), d AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
    "basis basis_change interest_change_1 interest_change_24 net share volume_24 log_return funding_year realized_vol",
    5,
)
def d_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basis, changes, nets, shares, window sums, log returns and realised volatility, composed of operators."""
    w = T.series()
    c = F.col
    p = ev_grid(spark, sf_dir).withColumns({"basis": X.div(c("close"), c("open")) - 1, "log_return": X.log_return(c("close"), F.lag("close").over(w))})
    return p.select(
        "symbol", "ts", "basis", T.ts_delta(c("basis"), 1, w).alias("basis_change"), T.ts_return(c("volume"), 1, w).alias("interest_change_1"),
        T.ts_return(c("volume"), 24, w).alias("interest_change_24"), X.bounded_ratio(X.div(c("high"), c("low"))).alias("net"), X.div(c("close"), c("volume")).alias("share"),
        T.ts_sum(c("volume"), 24, w).alias("volume_24"), "log_return", X.annualized_funding(c("trades") * 0.0001, F.lit(8)).alias("funding_year"),
        (T.ts_std(c("log_return"), 24, w) * F.sqrt(F.lit(24 * 365.25))).alias("realized_vol"),
    )


_TEMPLATES = (
    "basis_trade_spot basis_mark_index trade_mark_spread basis_change_1bar open_interest_change_1bar open_interest_change_24h toptrader_account_net toptrader_position_net global_account_net taker_flow_net spot_taker_buy_share perp_taker_buy_share "
    "spot_quote_volume_24h perp_quote_volume_24h perp_to_spot_quote_volume spot_log_return_1bar perp_log_return_1bar spot_perp_return_spread_1bar perp_realized_vol_24h"
)
#: Fields of a spot and perpetual panel, made of a nation's weekly prices, volumes and counts.
_FIELDS = {
    "spot_close": "open", "perp_close": "close * 25", "mark_close": "close * 24", "index_close": "open * 2", "spot_quote_volume": "CAST(volume AS DOUBLE)", "perp_quote_volume": "CAST(trades AS DOUBLE)", "spot_taker_buy_quote_volume": "CAST(trades AS DOUBLE)", "perp_taker_buy_quote_volume": "CAST(volume AS DOUBLE)",
    "open_interest_base": "CAST(trades AS DOUBLE)", "toptrader_account_long_short_ratio": "CAST(trades - 3 AS DOUBLE)", "toptrader_position_long_short_ratio": "CAST(volume AS DOUBLE)", "global_account_long_short_ratio": "close", "taker_long_short_volume_ratio": "open",
}


def _net_sql(x: str) -> str:
    return f"({x} - 1) / nullif({x} + 1, 0)"


@query(
    "d_factor_templates",
    f"""WITH {NATION_WEEK}, p AS (SELECT symbol, ts, {", ".join(f"{x} AS {n}" for n, x in _FIELDS.items())} FROM nw),
a AS (SELECT *, perp_close / nullif(spot_close, 0) - 1 AS basis_trade_spot, mark_close / nullif(index_close, 0) - 1 AS basis_mark_index, perp_close / nullif(mark_close, 0) - 1 AS trade_mark_spread,
  {", ".join(f"open_interest_base / nullif(lag(open_interest_base, {n}) OVER w, 0) - 1 AS open_interest_change_{x}" for n, x in ((1, "1bar"), (24, "24h")))}, {_net_sql("taker_long_short_volume_ratio")} AS taker_flow_net, {", ".join(f"{_net_sql(f'{n}_long_short_ratio')} AS {n}_net" for n in NETS[:3])},
  {", ".join(f"{m}_taker_buy_quote_volume / nullif({m}_quote_volume, 0) AS {m}_taker_buy_share, CASE WHEN count({m}_quote_volume) OVER d = 24 THEN sum({m}_quote_volume) OVER d END AS {m}_quote_volume_24h, ln({m}_close / lag({m}_close) OVER w) AS {m}_log_return_1bar" for m in ("spot", "perp"))}
  FROM p WINDOW w AS (PARTITION BY symbol ORDER BY ts), d AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
b AS (SELECT *, basis_trade_spot - lag(basis_trade_spot) OVER w AS basis_change_1bar, perp_quote_volume_24h / nullif(spot_quote_volume_24h, 0) AS perp_to_spot_quote_volume, perp_log_return_1bar - spot_log_return_1bar AS spot_perp_return_spread_1bar,
  CASE WHEN count(perp_log_return_1bar) OVER d = 24 THEN stddev_pop(perp_log_return_1bar) OVER d * sqrt(8766.0::DOUBLE) END AS perp_realized_vol_24h
FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts), d AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, {_TEMPLATES.replace(" ", ", ")} FROM b""",
    _TEMPLATES,
    5,
)
def d_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All named templates on fields made of each nation's prices, volumes and counts."""
    p = nation_week(spark, sf_dir).select("symbol", "ts", *[F.expr(x).alias(n) for n, x in _FIELDS.items()])
    return templates(p).select("symbol", "ts", *_TEMPLATES.split())


@query(
    "d_formula_families",
    """WITH f AS (SELECT event_type, CASE event_type WHEN 'click' THEN ['perp_close', 'perp_open'] WHEN 'view' THEN ['perp_volume', 'spot_trades'] WHEN 'purchase' THEN ['funding_rate'] WHEN 'signup' THEN ['open_interest_base'] ELSE ['perp_close', 'funding_rate'] END AS fields,
  CASE WHEN event_id % 2 = 0 THEN 'ts_std(x, 4)' ELSE 'ts_mean(x, 4)' END AS formula FROM events)
SELECT CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'mixed' WHEN event_type = 'click' AND contains(formula, 'ts_std') THEN 'volatility' WHEN event_type = 'click' THEN 'price' WHEN event_type = 'view' THEN 'volume' WHEN event_type = 'purchase' THEN 'funding' ELSE 'positioning' END AS family, count(*) AS n
FROM f GROUP BY 1""",
)
def d_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula classes from the fields and operators that a formula uses."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    lists = {"click": ["perp_close", "perp_open"], "view": ["perp_volume", "spot_trades"], "purchase": ["funding_rate"], "signup": ["open_interest_base"]}
    fields = F.array(F.lit("perp_close"), F.lit("funding_rate"))
    for kind, names in lists.items():
        fields = F.when(F.col("event_type") == kind, F.array(*map(F.lit, names))).otherwise(fields)
    formula = F.when(F.col("event_id") % 2 == 0, "ts_std(x, 4)").otherwise("ts_mean(x, 4)")
    return events.select(X.family(fields, formula).alias("family")).groupBy("family").agg(F.count("*").alias("n"))
