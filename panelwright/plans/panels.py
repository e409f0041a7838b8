"""Panel construction and point-in-time joins (P)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import panel as P
from panelwright.operators import selection as C
from panelwright.plans.base import EV_BARS, EV_GRID, NATION_WEEK, USER_UNIVERSE, ev_bars, ev_grid, nation_week, query, table, user_universe


def _available() -> Column:
    """When a row of an hour is known."""
    return F.expr("ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND")


@query("p_dense_grid", f"WITH {EV_GRID} SELECT symbol, ts, close, trades, present, ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS available_at FROM ev_grid", "close")
def p_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour of each symbol's span, missing bars as NULL, with the time each row is known."""
    return ev_grid(spark, sf_dir).select("symbol", "ts", "close", "trades", "present", _available().alias("available_at"))


@query(
    "p_attach_source",
    f"""WITH {EV_GRID}, o AS (SELECT symbol, ts, close * 2 AS price, ts + CASE WHEN trades % 3 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 59 MINUTE END AS close_time FROM ev_bars)
SELECT g.symbol, g.ts, g.close, CASE WHEN o.close_time <= g.ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND THEN o.price END AS other_price FROM ev_grid g LEFT JOIN o ON g.symbol = o.symbol AND g.ts = o.ts""",
    "close other_price",
)
def p_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another source's bar at the same key, hidden until it has closed."""
    base = ev_grid(spark, sf_dir).select("symbol", "ts", "close", _available().alias("available_at"))
    late = F.when(F.col("trades") % 3 == 0, F.expr("INTERVAL 2 HOUR")).otherwise(F.expr("INTERVAL 59 MINUTE"))
    other = ev_bars(spark, sf_dir).select("symbol", "ts", (F.col("close") * 2).alias("price"), (F.col("ts") + late).alias("close_time"))
    return P.attach(base, other, "other", ["price"]).drop("available_at")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("event_ts"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("interest"), F.when(F.col("event_id") % 3 != 0, F.col("user_id").cast("double")).alias("ratio"))


_METRICS = "metrics AS (SELECT event_type AS symbol, events.ts AS event_ts, CASE WHEN event_id % 7 <> 0 THEN value END AS interest, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS DOUBLE) END AS ratio FROM events)"


@query(
    "p_as_of_join",
    f"""WITH {EV_GRID}, {_METRICS}, l AS (SELECT symbol, ts, ts + INTERVAL 30 MINUTE AS at FROM ev_grid)
SELECT l.symbol, l.ts, m.event_ts AS observed, m.interest, m.ratio FROM l ASOF LEFT JOIN metrics m ON l.symbol = m.symbol AND l.at >= m.event_ts""",
    "interest ratio",
)
def p_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event at or before the middle of each hour, its NULLs included."""
    left = ev_grid(spark, sf_dir).select("symbol", "ts", F.expr("ts + INTERVAL 30 MINUTE").alias("at"))
    return P.as_of(left, _metrics(spark, sf_dir), "at", "event_ts").select("symbol", "ts", F.col("event.event_ts").alias("observed"), "event.interest", "event.ratio")


@query(
    "p_expiring_metrics",
    f"""WITH {EV_GRID}, {_METRICS}, l AS (SELECT symbol, ts, ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS seen_at FROM ev_grid), j AS (SELECT l.symbol, l.ts, l.seen_at, m.event_ts, m.interest, m.ratio, m.event_ts IS NOT NULL AND l.seen_at - m.event_ts < INTERVAL 20 MINUTE AS fresh FROM l ASOF LEFT JOIN metrics m ON l.symbol = m.symbol AND l.seen_at >= m.event_ts)
SELECT symbol, ts, CASE WHEN fresh THEN interest END AS interest, CASE WHEN fresh THEN ratio END AS ratio, CASE WHEN NOT fresh THEN 'stale' WHEN interest IS NULL AND ratio IS NULL THEN 'missing' WHEN interest IS NULL OR ratio IS NULL THEN 'partial' ELSE 'valid' END AS status,
  CASE WHEN fresh THEN (epoch_us(seen_at) - epoch_us(event_ts)) / 60e6 END AS age_minutes FROM j""",
    "interest ratio age_minutes",
)
def p_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that expire; the whole latest row counts, with its status and age."""
    left = ev_grid(spark, sf_dir).select("symbol", "ts", _available().alias("available_at"))
    return P.expiring(left, _metrics(spark, sf_dir), 20, ["interest", "ratio"]).drop("available_at")


_FUNDING = f"""funding AS (SELECT event_type AS symbol, events.ts AS event_ts, date_trunc('hour', events.ts) AS settle, CASE WHEN event_id % 41 = 0 THEN NULL ELSE value / 10000 END AS rate FROM events)"""


def _funding_sql(hours: int) -> str:
    return f"""WITH {EV_BARS}, {_FUNDING}, f AS (SELECT *, rate IS NOT NULL AS ok, lag(settle) OVER (PARTITION BY symbol ORDER BY event_ts) AS before FROM funding),
t AS (SELECT symbol, event_ts, settle, ok, rate, sum(CASE WHEN ok THEN rate ELSE 0 END) OVER r AS rates, sum((NOT ok)::INT) OVER r AS bad, max(CASE WHEN settle - before > INTERVAL 8 HOUR THEN settle - INTERVAL 8 HOUR END) OVER r AS lost, min(event_ts) OVER r AS first
  FROM f WINDOW r AS (PARTITION BY symbol ORDER BY event_ts ROWS UNBOUNDED PRECEDING)),
l AS (SELECT symbol, ts, ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS q, ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND - INTERVAL {hours} HOUR AS low FROM ev_bars),
n AS (SELECT l.*, t.event_ts AS latest, t.settle, t.ok, t.rate, t.rates, t.bad, t.lost, t.first FROM l ASOF LEFT JOIN t ON l.symbol = t.symbol AND l.q >= t.event_ts),
b AS (SELECT n.*, t.rates AS rates0, t.bad AS bad0 FROM n ASOF LEFT JOIN t ON n.symbol = t.symbol AND n.low >= t.event_ts),
s AS (SELECT *, CASE WHEN latest IS NULL THEN 'missing_event' WHEN coalesce(lost > low, false) THEN 'missing_settlement' WHEN NOT ok THEN 'invalid_event' WHEN q - settle >= INTERVAL 8 HOUR THEN 'missing_settlement' WHEN bad > coalesce(bad0, 0) THEN 'invalid_event' WHEN low < first THEN 'insufficient_history' ELSE 'valid' END AS funding_status FROM b)
SELECT symbol, ts, funding_status, CASE WHEN funding_status = 'valid' THEN rates - coalesce(rates0, 0) END AS funding_sum, rate AS funding_rate, CASE WHEN latest IS NOT NULL THEN 8.0::DOUBLE END AS interval_hours, latest AS observed, (epoch_us(q) - epoch_us(settle)) / 3600e6 AS funding_age_hours FROM s"""


def _funding(spark: SparkSession, sf_dir: str, hours: int) -> DataFrame:
    e = table(spark, sf_dir, "events")
    funding = e.select(F.col("event_type").alias("symbol"), F.col("ts").alias("event_ts"), F.when(F.col("event_id") % 41 != 0, F.col("value") / 10000).alias("rate"), F.lit(8.0).alias("interval_hours"))
    left = ev_bars(spark, sf_dir).select("symbol", "ts", _available().alias("available_at"))
    return P.funding_window(left, funding, hours).drop("available_at")


@query("p_funding_windows", _funding_sql(24), "funding_sum funding_rate funding_age_hours")
def p_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest funding event of every bar with its interval, observation time and age, and sums over 24 hours with their status."""
    return _funding(spark, sf_dir, 24)


@query("p_funding_windows_week", _funding_sql(168), "funding_sum funding_rate funding_age_hours")
def p_funding_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over 168 hours."""
    return _funding(spark, sf_dir, 168)


@query(
    "p_observed_ranges",
    f"SELECT symbol, count(*) AS rows, min(ts) AS ts_first, max(ts) AS ts_last, min(observed) AS observed_first, max(observed) AS observed_last, min(funding_age_hours) AS funding_age_hours_min, max(funding_age_hours) AS funding_age_hours_max FROM ({_funding_sql(24)}) GROUP BY symbol",
    "funding_age_hours_min funding_age_hours_max",
)
def p_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time ranges and ranges of age of what was observed, per symbol."""
    return P.ranges(_funding(spark, sf_dir, 24), ["ts", "observed"], ["funding_age_hours"], ["symbol"])


@query(
    "p_feature_frame",
    f"""WITH {EV_BARS}, {_METRICS}, g AS (SELECT event_type AS symbol, events.ts AS event_ts, CASE WHEN event_id % 41 = 0 THEN NULL ELSE value / 10000 END AS rate, CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE 8.0::DOUBLE END AS hours FROM events),
f AS (SELECT b.symbol, b.ts, close, rate AS funding_rate, CASE WHEN hours > 0 THEN hours END AS funding_interval_hours, g.event_ts AS funding_observed_at FROM ev_bars b ASOF LEFT JOIN g ON b.symbol = g.symbol AND b.ts >= g.event_ts)
SELECT f.*, m.interest, m.ratio, m.event_ts AS metrics_observed_at FROM f ASOF LEFT JOIN metrics m ON f.symbol = m.symbol AND f.ts >= m.event_ts""",
    "close funding_rate funding_interval_hours interest ratio",
)
def p_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with funding and metrics as they were known at the bar's open."""
    e = table(spark, sf_dir, "events")
    funding = e.select(
        F.col("event_type").alias("symbol"), F.col("ts").alias("event_ts"), F.when(F.col("event_id") % 41 != 0, F.col("value") / 10000).alias("rate"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(8.0).alias("interval_hours"),
    )
    return P.feature_frame(ev_bars(spark, sf_dir).select("symbol", "ts", "close"), funding, _metrics(spark, sf_dir), "ts", ["interest", "ratio"])


@query("p_look_ahead_guard", f"WITH {EV_BARS} SELECT symbol, ts, trades FROM ev_bars WHERE trades % 3 = 0")
def p_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that saw something before it was available; a spoilt observation time is found."""
    seen = ev_bars(spark, sf_dir).select("symbol", "ts", "trades", _available().alias("available_at"), (F.col("ts") + F.when(F.col("trades") % 3 == 0, F.expr("INTERVAL 2 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))).alias("observed"))
    return P.look_ahead(seen, ["observed"]).select("symbol", "ts", "trades")


@query(
    "p_warm_up_clip",
    f"""WITH {EV_GRID}, w AS (SELECT symbol, ts, CASE WHEN count(close) OVER d = 6 THEN avg(close) OVER d END AS mean FROM ev_grid WINDOW d AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
SELECT * FROM w WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-15'""",
    "mean",
)
def p_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: history as long as the operator's lookback is read, then clipped."""
    from panelwright.functions import window as T

    back = T.lookback("ts_mean", 6)
    read = ev_grid(spark, sf_dir).where(F.expr(f"ts >= TIMESTAMP_NTZ '2024-01-10' - INTERVAL {back} HOUR AND ts < TIMESTAMP_NTZ '2024-01-15'"))
    return read.select("symbol", "ts", T.ts_mean(F.col("close"), 6, T.series()).alias("mean")).where(F.expr("ts >= TIMESTAMP_NTZ '2024-01-10'"))


@query(
    "p_field_coverage",
    f"""WITH {USER_UNIVERSE}, m AS (SELECT symbol, eligible, CASE WHEN close > 5 THEN close END AS close, volume FROM us_uni), l AS (SELECT symbol, eligible, 'close' AS field, close AS v FROM m UNION ALL SELECT symbol, eligible, 'volume', volume FROM m)
SELECT symbol, field, count(*) AS rows, count(v) AS valid, count(v) / count(*) AS ratio, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND v IS NOT NULL) AS eligible_valid FROM l GROUP BY symbol, field""",
    "ratio",
)
def p_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields masked by their unit, and coverage per symbol and field."""
    u = user_universe(spark, sf_dir).withColumn("close", P.validity(F.col("close") - 5, "price") + 5)
    return P.coverage(u, ["close", "volume"], ["symbol"])


@query(
    "p_missing_reasons",
    f"""WITH {USER_UNIVERSE} SELECT symbol, CASE WHEN close IS NULL THEN 'missing' WHEN close - 5 <= 0 THEN 'invalid' ELSE 'none' END AS reason, count(*) AS rows FROM us_uni GROUP BY 1, 2""",
)
def p_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why cells have no value; symbols that aren't members keep their NULL rows."""
    x = F.col("close") - 5
    return user_universe(spark, sf_dir).groupBy("symbol", F.coalesce(P.reason(x, P.validity(x, "price")), F.lit("none")).alias("reason")).agg(F.count("*").alias("rows"))


@query(
    "p_next_bar_panel",
    f"""WITH {NATION_WEEK} SELECT symbol, ts, lead(open) OVER w AS next_open, lead(close) OVER w AS next_close, lead(close) OVER w * 25 / nullif(lead(open) OVER w, 0) - 1 AS next_return FROM nw WINDOW w AS (PARTITION BY symbol ORDER BY ts) QUALIFY next_return IS NOT NULL""",
    "next_open next_close next_return",
)
def p_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next bar's open-to-close return; rows without one go."""
    from panelwright.functions.pointwise import div
    from panelwright.functions.window import series

    w = series()
    n = nation_week(spark, sf_dir).select("symbol", "ts", F.lead("open").over(w).alias("next_open"), F.lead("close").over(w).alias("next_close"))
    return n.withColumn("next_return", div(F.col("next_close") * 25, F.col("next_open")) - 1).where("next_return is not null")


@query(
    "p_cohort_selection",
    f"""WITH {NATION_WEEK}, r AS (SELECT symbol, ts, volume FROM nw_bars WHERE ts >= TIMESTAMP '1998-01-05' AND ts < TIMESTAMP '1998-07-06'), full_ AS (SELECT symbol FROM r GROUP BY symbol HAVING count(*) = 26), d AS (SELECT symbol, date_trunc('month', ts) AS m, sum(volume) AS v FROM r WHERE symbol NOT IN ('n3', 'n7') GROUP BY 1, 2)
SELECT symbol, median(v) AS median_volume, row_number() OVER (ORDER BY median(v) DESC, symbol) AS place FROM d WHERE symbol IN (SELECT symbol FROM full_) GROUP BY symbol QUALIFY place <= 10""",
    "median_volume",
)
def p_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols complete before the cut, without excluded ones, ranked by the median of period volumes; a top-10 report."""
    r = nation_week(spark, sf_dir).where(F.expr("eligible AND ts >= TIMESTAMP_NTZ '1998-01-05' AND ts < TIMESTAMP_NTZ '1998-07-06'"))
    whole = r.groupBy("symbol").count().where("count = 26").select("symbol")
    excluded = spark.sql("SELECT explode(array('n3', 'n7')) AS symbol")
    months = r.join(excluded, "symbol", "left_anti").join(whole, "symbol", "left_semi").groupBy("symbol", F.date_trunc("month", "ts").alias("m")).agg(F.sum("volume").alias("v"))
    top = months.groupBy("symbol").agg(F.median("v").alias("median_volume")).orderBy(F.desc("median_volume"), "symbol").limit(10)
    from pyspark.sql import Window as W

    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("median_volume"), "symbol")).cast("long"))


@query(
    "p_hourly_membership",
    f"""WITH {USER_UNIVERSE}, h AS (SELECT ts, count(*) FILTER (eligible AND volume > 10) AS members FROM us_uni GROUP BY ts)
SELECT date_trunc('day', ts) AS day, count(*) AS hours, count(*) FILTER (members < 6) AS below_minimum, min(members) AS fewest, max(members) AS most FROM h GROUP BY 1""",
)
def p_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members an hour, and hours below the minimum by day."""
    return C.thin_times(C.members(user_universe(spark, sf_dir), F.col("eligible") & (F.col("volume") > 10)), 6)
