"""Further parts of panels, displacement, liquidations and comparisons: by stage, by horizon, by market, with totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import comparison as V
from panelwright.operators import displacement as R
from panelwright.operators import evaluate as E
from panelwright.operators import liquidations as L
from panelwright.operators import panel as P
from panelwright.plans.base import EV_BARS, EV_GRID, NATION_WEEK, USER_UNIVERSE, ev_bars, ev_grid, nation_week, query, table, user_universe
from panelwright.plans.evaluation import _D, _displaced
from panelwright.plans.liquidation import _USABLE, _usable
from panelwright.sources import tables as S

_STAGE = 26 * 7 * 86400


@query(
    "r_displacement_by_stage",
    f"WITH {_D}, s AS (SELECT *, CAST(floor((epoch(ts) - epoch(TIMESTAMP '1992-01-06')) / {_STAGE}) AS BIGINT) AS stage FROM dp) SELECT delta, stage, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS std, quantile_cont(d, 0.1) AS p10, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.9) AS p90, count(d) / count(*) AS valid_share FROM s GROUP BY delta, stage",
    "mean std p10 median p90 valid_share",
)
def r_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, exact quantiles and valid share of the displacement in each half-year."""
    stage = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("1992-01-06").cast("timestamp"))) / _STAGE)
    return R.distribution(_displaced(spark, sf_dir).withColumn("stage", stage), "d", ["delta", "stage"])


@query(
    "l_alignment_totals",
    f"""WITH {_USABLE} SELECT uu.symbol, count(*) AS rows, count(*) FILTER (count_usable) AS counted, count(*) FILTER (amount_usable) AS priced, CAST(sum(uu.events) AS BIGINT) AS events, sum(uu.long_notional) AS long_notional, sum(uu.short_notional) AS short_notional, CAST(sum(al.invalid) AS BIGINT) AS invalid, count(*) FILTER (uu.mismatch > 0) AS mismatches
FROM uu JOIN al ON al.symbol = uu.symbol AND al.ts = uu.ts GROUP BY uu.symbol""",
    "long_notional short_notional",
)
def l_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the aligned rows per symbol."""
    return L.alignment_totals(_usable(spark, sf_dir))


@query("l_top_mismatch_times", f"WITH {_USABLE} SELECT ts, count(*) AS rows FROM uu WHERE mismatch > 0 GROUP BY ts ORDER BY rows DESC, ts LIMIT 20")
def l_top_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 times with most files in another hour's place."""
    return L.most_frequent(_usable(spark, sf_dir), F.col("mismatch") > 0, "ts")


def _labels_sql(h: int) -> str:
    return f"SELECT {h} AS horizon, symbol, ts, eligible, trades, momentum, reversal, CASE WHEN eligible AND lead(open, 1) OVER w > 0 AND lead(open, {h + 1}) OVER w > 0 THEN lead(open, {h + 1}) OVER w / lead(open, 1) OVER w - 1 END AS fr FROM nw WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


_LABELS = f"{NATION_WEEK}, lb AS ({' UNION ALL '.join(map(_labels_sql, (1, 4, 24)))})"


@query(
    "v_labelled_support",
    f"WITH {_LABELS}, t AS (SELECT horizon, ts, count(*) AS n, count(fr) AS l, count(*) FILTER (momentum IS NOT NULL AND reversal IS NOT NULL) AS i, count(*) FILTER (momentum IS NOT NULL AND reversal IS NOT NULL AND fr IS NOT NULL) AS b FROM lb WHERE eligible GROUP BY 1, 2) SELECT horizon, CAST(sum(n) AS BIGINT) AS eligible, CAST(sum(l) AS BIGINT) AS labelled, CAST(sum(i) AS BIGINT) AS with_inputs, CAST(sum(b) AS BIGINT) AS with_both, count(*) FILTER (b >= 20) AS full_times FROM t GROUP BY horizon",
)
def v_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: eligible cells with a label, with all inputs and with both, per horizon."""
    return V.labelled_support(E.forward_labels(nation_week(spark, sf_dir), [1, 4, 24]), ["momentum", "reversal"])


@query(
    "v_label_comparison_horizons",
    f"WITH {_LABELS}, b AS (SELECT horizon, ts, fr AS x, CASE WHEN trades = 3 THEN NULL WHEN trades = 4 THEN fr + 0.5 ELSE fr END AS y FROM lb), t AS (SELECT horizon, ts, count(*) FILTER ((x IS NULL) <> (y IS NULL)) AS mm, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS c, count(*) FILTER (abs(x - y) > 1e-12) AS d FROM b GROUP BY 1, 2) SELECT horizon, CAST(sum(mm) AS BIGINT) AS mismatched, CAST(sum(c) AS BIGINT) AS common, count(*) FILTER (c >= 20) AS full_times, CAST(sum(d) AS BIGINT) AS different FROM t GROUP BY horizon",
)
def v_label_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: labels of two sources at every horizon; one source is spoilt on purpose."""
    a = E.forward_labels(nation_week(spark, sf_dir), [1, 4, 24]).select("horizon", "ts", "symbol", "trades", "forward_return")
    n = F.col("trades")
    return V.compare_labels(a, a.withColumn("forward_return", F.when(n == 3, None).when(n == 4, F.col("forward_return") + 0.5).otherwise(F.col("forward_return"))))


@query("s_tail_with_range", f"WITH {EV_BARS} SELECT symbol, ts, close, (SELECT count(*) FROM ev_bars) AS frame_rows, (SELECT min(ts) FROM ev_bars) AS frame_first, (SELECT max(ts) FROM ev_bars) AS frame_last FROM ev_bars ORDER BY ts DESC, symbol DESC LIMIT 50", "close")
def s_tail_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 bars beside the frame's range and number of rows."""
    return S.tail_snapshot(ev_bars(spark, sf_dir).select("symbol", "ts", "close"), 50, ["ts", "symbol"])


@query(
    "p_excluded_symbols",
    f"""WITH {EV_GRID}, n AS (SELECT symbol, lead(close) OVER w / nullif(lead(open) OVER w, 0) - 1 AS r FROM ev_grid WHERE symbol <> 'error' OR ts = (SELECT min(ts) FROM ev_grid g WHERE g.symbol = 'error') WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
a AS (SELECT DISTINCT event_type AS symbol FROM events UNION SELECT 'delisted') SELECT a.symbol, CASE WHEN EXISTS (SELECT 1 FROM ev_bars b WHERE b.symbol = a.symbol) THEN 'no_next_bar' ELSE 'no_bars' END AS reason FROM a WHERE symbol NOT IN (SELECT symbol FROM n WHERE r IS NOT NULL)""",
)
def p_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that the next-bar panel can't have, with the reason; one has a single bar left, one none."""
    grid = ev_grid(spark, sf_dir)
    first = grid.where("symbol = 'error'").groupBy("symbol").agg(F.min("ts").alias("ts"))
    kept = grid.where("symbol <> 'error'").unionByName(grid.join(first, ["symbol", "ts"], "left_semi"))
    asked = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct().unionByName(spark.sql("SELECT 'delisted' AS symbol"))
    return P.excluded_symbols(asked, kept, P.next_bar_panel(kept))


_MARKETS = """mk AS (SELECT 'u' || CAST(user_id % 12 AS VARCHAR) || CASE user_id % 12 WHEN 9 THEN 'UP' WHEN 10 THEN 'BEAR' ELSE '' END AS symbol, CASE WHEN event_id % 2 = 0 THEN 'spot' ELSE 'perp' END AS market, date_trunc('day', events.ts) AS ts, arg_max(value, events.ts) AS close, sum(value) AS volume FROM events WHERE events.ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2, 3),
va AS (SELECT * FROM mk WHERE close > 0 AND volume >= 0), fu AS (SELECT symbol FROM va GROUP BY symbol HAVING count(*) FILTER (market = 'spot') = 24 AND count(*) FILTER (market = 'perp') = 24)"""


@query(
    "p_cohort_two_markets",
    f"WITH {_MARKETS}, md AS (SELECT symbol, median(volume) AS median_volume FROM va WHERE market = 'spot' GROUP BY symbol) SELECT symbol, median_volume, row_number() OVER (ORDER BY median_volume DESC, symbol) AS place FROM md WHERE symbol IN (SELECT symbol FROM fu) AND symbol NOT IN ('u3', 'u7') AND NOT regexp_matches(symbol, '(UP|DOWN|BULL|BEAR)$') QUALIFY place <= 5",
    "median_volume",
)
def p_cohort_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols with every day before the cut in both markets, without named and leveraged ones, by the median of daily volumes; a top-5 report."""
    e = table(spark, sf_dir, "events").where(F.expr("ts < TIMESTAMP_NTZ '2024-01-25 00:00:00'"))
    k = F.col("user_id") % 12
    name = F.concat(F.lit("u"), k.cast("string"), F.when(k == 9, "UP").when(k == 10, "BEAR").otherwise(""))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    spot, perp = (P.bars(e.where(F.col("event_id") % 2 == odd), name, bucket=day) for odd in (0, 1))
    return P.cohort({"spot": spot, "perp": perp}, 24, spark.sql("SELECT explode(array('u3', 'u7')) AS symbol"), 5)


@query(
    "p_field_hours",
    f"WITH {USER_UNIVERSE}, h AS (SELECT ts, count(*) FILTER (eligible) AS e, count(*) FILTER (eligible AND close IS NOT NULL) AS close, count(*) FILTER (eligible AND volume > 20) AS busy, count(*) FILTER (eligible AND trades > 1) AS trades FROM us_uni GROUP BY ts), l AS (SELECT 'close' AS field, e, close AS n FROM h UNION ALL SELECT 'busy', e, busy FROM h UNION ALL SELECT 'trades', e, trades FROM h) SELECT field, CAST(sum(e) AS BIGINT) AS eligible, CAST(sum(n) AS BIGINT) AS valid, count(*) FILTER (n >= 6) AS full_times, count(*) AS times FROM l GROUP BY field",
)
def p_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible rows with a value, and hours with enough of them, for each field."""
    u = user_universe(spark, sf_dir).withColumns({"busy": F.when(F.col("volume") > 20, F.col("volume")), "trades": F.when(F.col("trades") > 1, F.col("trades"))})
    return P.field_hours(u, ["close", "busy", "trades"], 6)
