"""Labels, single-factor evaluation (E) and rank displacement (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions import cross as C
from panelwright.functions import window as T
from panelwright.operators import displacement as R
from panelwright.operators import evaluate as E
from panelwright.operators import ranking as M
from panelwright.operators import selection
from panelwright.plans.base import NATION_WEEK, avg_rank_sql, nation_week, query, tidy, tidy_sql

_END = "1999-06-07"
_HORIZONS = (1, 4)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.forward_labels(nation_week(spark, sf_dir), [*_HORIZONS], F.expr(f"TIMESTAMP_NTZ '{_END}'"))


_LABELS = f"""{NATION_WEEK}, lab AS (
  {" UNION ALL ".join(f'''SELECT symbol, ts, eligible, momentum, activity, reversal, {h} AS horizon, lead(ts, 1) OVER w AS label_start, lead(ts, {h + 1}) OVER w AS label_end,
    CASE WHEN eligible AND lead(open, 1) OVER w > 0 AND lead(open, {h + 1}) OVER w > 0 THEN lead(open, {h + 1}) OVER w / lead(open, 1) OVER w - 1 END AS forward_return,
    lead(ts, {h + 1}) OVER w IS NULL OR lead(ts, {h + 1}) OVER w >= TIMESTAMP '{_END}' AS purged FROM nw WINDOW w AS (PARTITION BY symbol ORDER BY ts)''' for h in _HORIZONS)})"""


def _periods_sql(labels: str = "lab", factor: str = "activity", prefix: str = "") -> str:
    """CTEs: clean rows with ranks and groups (5), and a row per horizon and time."""
    return f"""{prefix}cl AS (SELECT *, CASE WHEN eligible AND NOT purged AND {factor} IS NOT NULL AND forward_return IS NOT NULL THEN {factor} END AS x, CASE WHEN eligible AND NOT purged AND {factor} IS NOT NULL AND forward_return IS NOT NULL THEN forward_return END AS y FROM {labels}),
{prefix}rk AS (SELECT *, {avg_rank_sql("x", "horizon, ts")} AS rx, {avg_rank_sql("y", "horizon, ts")} AS ry, count(x) OVER (PARTITION BY horizon, ts) AS nn FROM {prefix}cl),
{prefix}gr AS (SELECT *, CAST(least(floor((rx - 1) / nn * 5) + 1, 5) AS INTEGER) AS g FROM {prefix}rk),
{prefix}ag AS (SELECT horizon, ts, count(*) FILTER (eligible) AS eligible, count(x) AS n, count(*) FILTER (purged AND eligible) AS purged, count(DISTINCT x) AS dx, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic,
  {", ".join(f"avg(y) FILTER (g = {g}) AS group_{g}, count(*) FILTER (g = {g}) AS group_{g}_n" for g in range(1, 6))} FROM {prefix}gr GROUP BY horizon, ts),
{prefix}st AS (SELECT *, CASE WHEN purged > 0 THEN 'purged_boundary' WHEN n < 20 OR dx < 5 THEN 'insufficient_cross_section' WHEN least({", ".join(f"group_{g}_n" for g in range(1, 6))}) = 0 THEN 'empty_group_due_to_ties' ELSE 'computed' END AS status FROM {prefix}ag),
{prefix}per AS (SELECT horizon, ts, eligible, n, purged, status, CASE WHEN status IN ('computed', 'empty_group_due_to_ties') THEN ic END AS rank_ic, {", ".join(f"group_{g}, group_{g}_n" for g in range(1, 6))},
  CASE WHEN status = 'computed' THEN group_5 - group_1 END AS spread, -CASE WHEN status = 'computed' THEN group_5 - group_1 END AS directional_spread FROM {prefix}st)"""


def _periods(spark: SparkSession, sf_dir: str, factor: str = "activity") -> DataFrame:
    return E.periods(_labelled(spark, sf_dir), factor, ["horizon"], 5, 20, -1)


@query(
    "flagship_rank_ic",
    f"""WITH {NATION_WEEK}, f AS (SELECT *, {tidy_sql("close / nullif(lag(close, 3) OVER w, 0) - 1", 6)} AS ret, CASE WHEN eligible AND lead(open, 1) OVER w > 0 AND lead(open, 2) OVER w > 0 THEN lead(open, 2) OVER w / lead(open, 1) OVER w - 1 END AS forward_return FROM nw WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
r AS (SELECT ts, CASE WHEN eligible AND forward_return IS NOT NULL THEN ret END AS x, CASE WHEN eligible AND ret IS NOT NULL THEN forward_return END AS y FROM f),
k AS (SELECT *, {avg_rank_sql("x", "ts")} AS rx, {avg_rank_sql("y", "ts")} AS ry FROM r)
SELECT ts, count(x) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rank_ic FROM k GROUP BY ts HAVING count(x) >= 3""",
    "rank_ic",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of customer nations from their line items, dense grid, three-week return, next-open label, rank IC per week."""
    panel = nation_week(spark, sf_dir).withColumn("ret", tidy(T.ts_return(F.col("close"), 3, T.series()), 6))
    lab = E.forward_labels(panel, [1])
    both = lab.select("ts", F.when(F.col("forward_return").isNotNull(), F.when(F.col("eligible"), F.col("ret"))).alias("x"), F.when(F.col("ret").isNotNull(), F.col("forward_return")).alias("y"))
    ranked = both.withColumns({"rx": C.average_rank(F.col("x"), "ts"), "ry": C.average_rank(F.col("y"), "ts")})
    return ranked.groupBy("ts").agg(F.count("x").alias("n"), C.correlation(F.col("rx"), F.col("ry")).alias("rank_ic")).where("n >= 3")


@query("e_forward_labels", f"WITH {_LABELS} SELECT symbol, ts, horizon, label_start, label_end, forward_return, purged FROM lab", "forward_return")
def e_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next-open forward returns for two horizons, purged at the segment's end."""
    return _labelled(spark, sf_dir).select("symbol", "ts", "horizon", "label_start", "label_end", "forward_return", "purged")


_GROUPS = " ".join(f"group_{g}" for g in range(1, 6))


@query("e_period_cross_sections", f"WITH {_LABELS}, {_periods_sql()} SELECT * FROM per", f"rank_ic spread directional_spread {_GROUPS}")
def e_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, rank IC, tied quantile groups and spreads of every period."""
    return _periods(spark, sf_dir)


@query("e_sampled_times", f"WITH {_LABELS} SELECT symbol, ts, horizon, activity FROM lab WHERE date_diff('week', TIMESTAMP '1995-01-02', ts) % 4 = 0", "activity")
def e_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth week from a start."""
    return E.sampled(_labelled(spark, sf_dir), F.expr("TIMESTAMP_NTZ '1995-01-02'"), 4, 7 * 86400).select("symbol", "ts", "horizon", "activity")


def _p_sql(statistic: str) -> str:
    """The two-sided normal p value by the approximation that the library uses."""
    z = f"(abs({statistic}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + {z} / 2))"
    power = f"({E.ERFC[-1]!r}::DOUBLE)"
    for c in E.ERFC[-2::-1]:
        power = f"(({c!r}::DOUBLE) + {t} * {power})"
    return f"{t} * exp({power} - {z} * {z})"


def _hac_sql(source: str, value: str, keys: str, lags: int, least: int, prefix: str = "") -> str:
    cross = " + ".join(f"{2 * (1 - k / (lags + 1))!r}::DOUBLE * coalesce(sum(u * l{k}), 0)" for k in range(1, lags + 1))
    p = prefix
    return f"""{p}hc AS (SELECT {keys}, ts, {value} AS x, coalesce({value} - avg({value}) OVER (PARTITION BY {keys}), 0) AS u FROM {source}),
{p}hl AS (SELECT *, {", ".join(f"lag(u, {k}) OVER (PARTITION BY {keys} ORDER BY ts) AS l{k}" for k in range(1, lags + 1))} FROM {p}hc),
{p}ha AS (SELECT {keys}, count(x) AS n, count(*) AS grid_periods, avg(x) AS mean, stddev_samp(x) AS std, sum(u * u) + {cross} AS total, min(x) < max(x) AS varies FROM {p}hl GROUP BY {keys}),
{p}hs AS (SELECT *, CASE WHEN n < {least} THEN 'insufficient_evidence' WHEN NOT coalesce(varies, false) OR total <= 0 THEN 'degenerate_variance' ELSE 'estimated' END AS status FROM {p}ha),
{p}hac AS (SELECT {keys}, n, grid_periods, mean, std, status, CASE WHEN status = 'estimated' THEN sqrt(total / (n * (n - 1.0::DOUBLE))) END AS se FROM {p}hs)"""


@query(
    "e_hac_inference",
    f"WITH {_LABELS}, {_periods_sql()}, {_hac_sql('per', 'rank_ic', 'horizon', 3, 26)} SELECT horizon, n, grid_periods, mean, std, status, se, mean - 1.959963984540054 * se AS ci_low, mean + 1.959963984540054 * se AS ci_high, mean / se AS statistic, {_p_sql('mean / se')} AS p_value FROM hac",
    "mean std se ci_low ci_high statistic p_value",
)
def e_hac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newey-West mean of rank IC over the full grid of periods, with its p value."""
    return E.with_p_values(E.hac(_periods(spark, sf_dir), "rank_ic", ["horizon"], 3, 26))


@query(
    "e_summary",
    f"""WITH {_LABELS}, {_periods_sql()} SELECT horizon, avg(CASE WHEN rank_ic IS NOT NULL THEN (-round(rank_ic, 12) > 0)::INT END) AS ic_direction_share, avg(CASE WHEN directional_spread IS NOT NULL THEN (directional_spread > 0)::INT END) AS spread_direction_share,
  avg(spread) AS spread_mean, avg(rank_ic) AS ic_mean, CAST(sum(eligible) AS BIGINT) AS eligible, CAST(sum(purged) AS BIGINT) AS purged, {", ".join(f"avg(group_{g}) AS group_{g}" for g in range(1, 6))},
  {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("computed", "purged_boundary", "insufficient_cross_section", "empty_group_due_to_ties"))} FROM per GROUP BY horizon""",
    f"ic_direction_share spread_direction_share spread_mean ic_mean {_GROUPS}",
)
def e_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction shares, group means, status counts."""
    return E.summary(_periods(spark, sf_dir), ["horizon"], 5, -1)


@query(
    "e_stage_buckets",
    f"""WITH {_LABELS}, {_periods_sql()}, s AS (SELECT horizon, CAST(floor((epoch(ts) - epoch(TIMESTAMP '1995-01-02')) / (3600 * 4368)) AS INTEGER) AS stage, min(ts) AS "first", max(ts) AS "last", count(rank_ic) AS n_ic, count(directional_spread) AS n_spread, avg(rank_ic) AS mean_ic, avg(directional_spread) AS mean_spread FROM per GROUP BY 1, 2)
SELECT *, n_ic >= 10 AND n_spread >= 10 AS valid, n_ic >= 10 AND n_spread >= 10 AND -mean_ic > 0 AND mean_spread > 0 AS positive FROM s""",
    "mean_ic mean_spread",
)
def e_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries per stretch of 26 weeks, anchored at the whole segment."""
    found = E.stages(_periods(spark, sf_dir), ["horizon"], F.expr("TIMESTAMP_NTZ '1995-01-02'"), 26 * 168, -1, 10)
    return found.withColumn("positive", F.coalesce("positive", F.lit(False)))


@query(
    "e_rolling_means",
    f"""WITH {_LABELS}, {_periods_sql()} SELECT horizon, ts, CASE WHEN count(rank_ic) OVER w = 26 THEN avg(rank_ic) OVER w END AS rolling_ic, CASE WHEN count(directional_spread) OVER w = 26 THEN avg(directional_spread) OVER w END AS rolling_spread
FROM per WINDOW w AS (PARTITION BY horizon ORDER BY ts ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)""",
    "rolling_ic rolling_spread",
)
def e_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling means of IC and spread over 26 periods."""
    return E.rolling(_periods(spark, sf_dir), ["horizon"], 26)


@query("e_per_symbol", f"WITH {_LABELS} SELECT horizon, symbol, count(*) AS n, avg(forward_return) AS mean_return, avg(activity) AS mean_factor FROM lab WHERE eligible AND NOT purged AND activity IS NOT NULL AND forward_return IS NOT NULL GROUP BY 1, 2", "mean_return mean_factor")
def e_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows and means per symbol."""
    return E.per_symbol(_labelled(spark, sf_dir), "activity", ["horizon"])


@query(
    "m_directed_calibration",
    f"""WITH {_LABELS}, {_periods_sql()}, {_hac_sql('per', 'rank_ic', 'horizon', 3, 26)}, yr AS (SELECT horizon, extract(year FROM ts) AS y, -avg(rank_ic) AS ic FROM per GROUP BY 1, 2), sg AS (SELECT horizon, count(ic) AS valid_stages, avg((ic > 0)::INT) AS positive_stage_share FROM yr GROUP BY 1),
gm AS (SELECT horizon, {", ".join(f"avg(group_{g}) AS g{g}" for g in range(1, 6))} FROM per GROUP BY 1), sh AS (SELECT horizon, max(n) / sum(n) AS largest_symbol_share FROM (SELECT horizon, symbol, count(*) AS n FROM lab WHERE eligible AND NOT purged AND activity IS NOT NULL AND forward_return IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT hac.horizon, -hac.mean AS directed_ic, -hac.mean - 1.959963984540054 * se AS directed_low, -hac.mean + 1.959963984540054 * se AS directed_high, -hac.mean / nullif(std, 0) AS icir, valid_stages, positive_stage_share, {" + ".join(f"coalesce((g{g} - g{g + 1} >= 0)::INT, 0)" for g in range(1, 5))} AS adjacent_in_direction, {" + ".join(f"(g{g} - g{g + 1} IS NOT NULL)::INT" for g in range(1, 5))} AS adjacent_estimable, largest_symbol_share
FROM hac JOIN sg USING (horizon) JOIN gm USING (horizon) JOIN sh USING (horizon)""",
    "directed_ic directed_low directed_high icir positive_stage_share largest_symbol_share",
)
def m_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed IC with its interval, share of positive years, adjacent groups in direction, largest symbol's share."""
    labelled = _labelled(spark, sf_dir)
    return M.directed_calibration(E.periods(labelled, "activity", ["horizon"], 5, 20, -1), E.per_symbol(labelled, "activity", ["horizon"]), ["horizon"], -1, 5, 3, 26)


_COMMON = f"""{_LABELS}, co AS (SELECT *, min((NOT purged AND forward_return IS NOT NULL AND activity IS NOT NULL)::INT) OVER (PARTITION BY ts, symbol) AS al, max(purged::INT) OVER (PARTITION BY ts, symbol) AS mp FROM lab),
cm AS (SELECT symbol, ts, eligible, activity, horizon, CASE WHEN al = 1 THEN forward_return END AS forward_return, mp = 1 AS purged FROM co)"""


@query("e_horizon_comparison", f"WITH {_COMMON}, {_periods_sql('cm')} SELECT horizon, ts, n, status, rank_ic, spread FROM per", "rank_ic spread")
def e_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizons compared on the observations that all of them have."""
    common = E.common_support(_labelled(spark, sf_dir), "activity")
    return E.periods(common, "activity", ["horizon"], 5, 20, -1).select("horizon", "ts", "n", "status", "rank_ic", "spread")


_ALPHA = 0.05

_TESTS = f"""{_LABELS}, {_periods_sql()}, py AS (SELECT *, CAST(extract(year FROM ts) AS INTEGER) AS year FROM per), {_hac_sql("py", "rank_ic", "year, horizon", 3, 26)},
qs AS (SELECT year, horizon, CAST(floor((epoch(ts) - epoch(TIMESTAMP '1992-01-06')) / (3600 * 2184)) AS INTEGER) AS stage, count(rank_ic) >= 5 AND count(directional_spread) >= 5 AS valid, coalesce(-avg(rank_ic) > 0 AND avg(directional_spread) > 0, false) AS good FROM py GROUP BY 1, 2, 3),
sh AS (SELECT year, horizon, count(*) FILTER (valid AND good) / nullif(count(*) FILTER (valid), 0) AS positive_stage_share FROM qs GROUP BY 1, 2),
sp AS (SELECT year, horizon, avg(spread) AS spread_mean FROM py GROUP BY 1, 2),
pv AS (SELECT hac.year, hac.horizon, hac.mean AS ic_mean, spread_mean, n, {_p_sql("hac.mean / hac.se")} AS p_value, hac.horizon * 10000 + hac.year AS test, positive_stage_share FROM hac JOIN sp ON sp.year = hac.year AND sp.horizon = hac.horizon JOIN sh ON sh.year = hac.year AND sh.horizon = hac.horizon),
bo AS (SELECT *, coalesce(p_value, 1) AS pp, row_number() OVER (ORDER BY coalesce(p_value, 1), test) AS k, count(*) OVER () AS m FROM pv),
bh AS (SELECT *, min(least(1, pp * m / k)) OVER (ORDER BY pp, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q_value FROM bo)"""


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test per year and horizon: IC with its p value, spread, share of positive quarters, and the corrected value."""
    yearly = _periods(spark, sf_dir).withColumn("year", F.year("ts"))
    keys = ["year", "horizon"]
    tested = E.with_p_values(E.hac(yearly, "rank_ic", keys, 3, 26)).select(*keys, F.col("mean").alias("ic_mean"), "n", "p_value")
    spread = yearly.groupBy(*keys).agg(F.avg("spread").alias("spread_mean"))
    share = E.stages(yearly, keys, F.expr("TIMESTAMP_NTZ '1992-01-06'"), 13 * 168, -1, 5).groupBy(*keys).agg((F.count_if(F.coalesce("positive", F.lit(False))) / F.nullif(F.count_if("valid"), F.lit(0))).alias("positive_stage_share"))
    tests = tested.join(spread, keys).join(share, keys).withColumn("test", F.col("horizon") * 10000 + F.col("year"))
    return E.benjamini_hochberg(tests, _ALPHA)


@query(
    "e_benjamini_hochberg",
    f"WITH {_TESTS} SELECT year, horizon, ic_mean, spread_mean, n, p_value, test, q_value, positive_stage_share, p_value IS NOT NULL AND q_value <= {_ALPHA} AS rejected FROM bh",
    "ic_mean spread_mean p_value q_value positive_stage_share",
)
def e_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected values over a family of yearly tests of IC; a missing p counts as 1 and is never rejected."""
    return _tests(spark, sf_dir)


@query(
    "e_admission",
    f"""WITH {_TESTS} SELECT year, horizon, concat_ws(',', CASE WHEN NOT (p_value IS NOT NULL AND q_value <= {_ALPHA}) THEN 'not_significant' END, CASE WHEN coalesce(-ic_mean < 0.01, true) THEN 'ic_below_minimum' END, CASE WHEN coalesce(-spread_mean <= 0, true) THEN 'spread_not_positive' END) AS reasons,
  p_value IS NOT NULL AND q_value <= {_ALPHA} AND coalesce(-ic_mean >= 0.01, false) AND coalesce(-spread_mean > 0, false) AS admitted,
  CASE WHEN abs(spread_mean) >= 0.001 AND coalesce(positive_stage_share, 0) >= 0.75 THEN 'strong' WHEN abs(spread_mean) >= 0.0005 AND coalesce(positive_stage_share, 0) >= 0.5 THEN 'steady' ELSE 'weak' END AS track FROM bh""",
)
def e_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons against admission and a descriptive track."""
    return E.admission(_tests(spark, sf_dir), -1, 0.01).select("year", "horizon", F.concat_ws(",", "reasons").alias("reasons"), "admitted", "track")


@query(
    "e_candidate_verdict",
    f"""WITH {_TESTS}, ad AS (SELECT year AS candidate, horizon FROM bh WHERE p_value IS NOT NULL AND q_value <= {_ALPHA} AND -ic_mean >= 0.01 AND -spread_mean > 0), pa AS (SELECT c.candidate, coalesce(string_agg(CAST(a.horizon AS VARCHAR), ',' ORDER BY a.horizon), '') AS passed,
  coalesce(string_agg(CASE WHEN (c.candidate + a.horizon) % 2 = 0 THEN CAST(a.horizon AS VARCHAR) END, ',' ORDER BY a.horizon), '') AS horizons FROM (SELECT DISTINCT year AS candidate FROM bh) c LEFT JOIN ad a ON a.candidate = c.candidate GROUP BY 1)
SELECT candidate, passed, horizons, horizons <> '' AS validated FROM pa""",
)
def e_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted horizons that were retained before, per candidate."""
    tests = E.admission(_tests(spark, sf_dir), -1, 0.01).withColumn("candidate", F.col("year"))
    retained = tests.where((F.col("candidate") + F.col("horizon")) % 2 == 0).select("candidate", "horizon")
    return E.verdict(tests, retained).select("candidate", F.concat_ws(",", F.col("passed").cast("array<string>")).alias("passed"), F.concat_ws(",", F.col("horizons").cast("array<string>")).alias("horizons"), "validated")


_PAIRED = f"""{_LABELS}, {_periods_sql()}, {_periods_sql("lab", "reversal", "b_")}, pd AS (SELECT per.horizon, per.ts, b_per.rank_ic - per.rank_ic AS difference FROM per JOIN b_per ON per.horizon = b_per.horizon AND per.ts = b_per.ts), {_hac_sql("pd", "difference", "horizon", 3, 26)}"""


@query(
    "e_paired_experiment",
    f"""WITH {_PAIRED} SELECT horizon, n, mean, se, status, CASE WHEN status <> 'estimated' THEN 'pause' WHEN mean - 1.959963984540054 * se > 0 AND mean >= 0.01 THEN 'continue' WHEN mean + 1.959963984540054 * se < 0 THEN 'stop' ELSE 'pause' END AS decision FROM hac""",
    "mean se",
)
def e_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors' IC compared on one calendar, with a decision."""
    found = E.compare(_periods(spark, sf_dir), _periods(spark, sf_dir, "reversal"), ["horizon"], "rank_ic", 3, 26, 0.01)
    return found.select("horizon", "n", "mean", "se", "status", "decision")


_GATE = f"""{_LABELS}, {_periods_sql()}, {_periods_sql("lab", "reversal", "b_")}, pd AS (SELECT per.horizon, per.ts, b_per.rank_ic - per.rank_ic AS ic, b_per.directional_spread - per.directional_spread AS spread FROM per JOIN b_per ON per.horizon = b_per.horizon AND per.ts = b_per.ts),
{_hac_sql("pd", "ic", "horizon", 3, 26, "i_")}, {_hac_sql("pd", "spread", "horizon", 3, 26, "s_")}"""


@query(
    "e_quality_gate",
    f"""WITH {_GATE} SELECT s.horizon, s.mean, i.mean - 1.959963984540054 * i.se AS ic_ci_low, coalesce(s.mean >= 0.0 AND s.mean - 1.959963984540054 * s.se > 0 AND i.mean - 1.959963984540054 * i.se >= -0.05, false) AS passed FROM s_hac s JOIN i_hac i ON i.horizon = s.horizon""",
    "mean ic_ci_low",
)
def e_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired evidence on the spread against a target and its interval, and a bound on the IC that is lost."""
    a, b = _periods(spark, sf_dir), _periods(spark, sf_dir, "reversal")
    gain = E.compare(a, b, ["horizon"], "directional_spread", 3, 26, 0.01)
    ic = E.compare(a, b, ["horizon"], "rank_ic", 3, 26, 0.01).select("horizon", F.col("ci_low").alias("ic_ci_low"))
    return E.quality_gate(gain.join(ic, "horizon"), 0.0, 0.05).select("horizon", "mean", "ic_ci_low", "passed")


@query(
    "e_evidence_completeness",
    f"""WITH {_LABELS}, {_periods_sql()}, e AS (SELECT CAST(extract(year FROM ts) AS INTEGER) AS candidate, horizon, avg(rank_ic) AS ic_mean, avg(spread) AS spread_mean, count(rank_ic) / count(*) AS valid_share FROM per GROUP BY 1, 2), r AS (SELECT y AS candidate, h AS horizon FROM (SELECT unnest(generate_series(1994, 2003)) AS y), (SELECT unnest([1, 4, 24]) AS h)),
x AS (SELECT CAST(r.candidate AS INTEGER) AS candidate, r.horizon, concat_ws(',', CASE WHEN ic_mean IS NULL THEN 'ic_mean' END, CASE WHEN spread_mean IS NULL THEN 'spread_mean' END, CASE WHEN NOT coalesce(valid_share > 0 AND valid_share <= 1, false) THEN 'valid_share' END) AS lacking FROM r LEFT JOIN e ON e.candidate = r.candidate AND e.horizon = r.horizon)
SELECT * FROM x WHERE lacking <> ''""",
)
def e_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required candidate and horizon pairs with missing parts of evidence."""
    e = _periods(spark, sf_dir).groupBy(F.year("ts").alias("candidate"), "horizon").agg(F.avg("rank_ic").alias("ic_mean"), F.avg("spread").alias("spread_mean"), (F.count("rank_ic") / F.count("*")).alias("valid_share"))
    required = spark.sql("SELECT candidate, explode(array(1, 4, 24)) AS horizon FROM (SELECT explode(sequence(1994, 2003)) AS candidate)")
    return E.incomplete(e, required, ["ic_mean", "spread_mean"]).withColumn("lacking", F.concat_ws(",", "lacking"))


_STEPS = (1, 4)
_WEEK = 7 * 86400

_D = f"""{NATION_WEEK}, lv AS (SELECT symbol, ts, activity AS x FROM nw WHERE eligible AND activity IS NOT NULL), dl AS (SELECT unnest([1, 4]) AS delta),
pr AS (SELECT dl.delta, a.ts, a.symbol, a.x AS now_, b.x AS then_ FROM lv a CROSS JOIN dl JOIN lv b ON b.symbol = a.symbol AND b.ts = a.ts - dl.delta * INTERVAL 7 DAY),
rr AS (SELECT *, {avg_rank_sql("now_", "delta, ts")} AS ra, {avg_rank_sql("then_", "delta, ts")} AS rb FROM pr),
mv AS (SELECT delta, ts, count(*) AS n, sum(abs(ra - rb)) AS s, count(*) - count(DISTINCT now_) AS ties_now, count(*) - count(DISTINCT then_) AS ties_then FROM rr GROUP BY 1, 2),
ct AS (SELECT ts, count(*) FILTER (eligible AND activity IS NOT NULL) AS n_now FROM nw GROUP BY ts),
gd AS (SELECT dl.delta, c.ts, c.n_now, p.n_now AS n_then_, c.ts - dl.delta * INTERVAL 7 DAY < (SELECT min(ts) FROM nw) AS before FROM ct c CROSS JOIN dl LEFT JOIN ct p ON p.ts = c.ts - dl.delta * INTERVAL 7 DAY),
dd AS (SELECT gd.delta, gd.ts, n_now, coalesce(n_then_, 0) AS n_then, coalesce(n, 0) AS n, coalesce(ties_now, 0) AS ties_now, coalesce(ties_then, 0) AS ties_then, coalesce(n, 0) / nullif(n_now + coalesce(n_then_, 0) - coalesce(n, 0), 0) AS coverage,
  CASE WHEN before THEN 'boundary_excluded' WHEN n_then_ IS NULL THEN 'missing_exact_hour' WHEN coalesce(n, 0) < 20 THEN 'insufficient_cross_section' ELSE 'computed' END AS status, s FROM gd LEFT JOIN mv ON mv.delta = gd.delta AND mv.ts = gd.ts),
dp AS (SELECT delta, ts, n_now, n_then, n, ties_now, ties_then, coverage, status, CASE WHEN status = 'computed' THEN s / (n * n) END AS d FROM dd)"""


def _displaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.displacement(nation_week(spark, sf_dir), "activity", [*_STEPS], [], 20, _WEEK)


@query("r_rank_displacement", f"WITH {_D} SELECT * FROM dp", "coverage d")
def r_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement over 1 and 4 weeks with statuses, ties and coverage."""
    return _displaced(spark, sf_dir)


@query("r_displacement_summary", f"WITH {_D} SELECT delta, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS std, quantile_cont(d, 0.1) AS p10, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.9) AS p90, count(d) / count(*) AS valid_share FROM dp GROUP BY delta", "mean std p10 median p90 valid_share")
def r_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, exact quantiles and valid share of the displacement."""
    return R.distribution(_displaced(spark, sf_dir), "d", ["delta"])


@query("r_distribution_by_class", f"WITH {_D}, c AS (SELECT delta % 2 AS class, d FROM dp) SELECT class, CAST(grouping(class) AS INTEGER) AS is_total, count(d) AS n, avg(d) AS mean, stddev_samp(d) AS std, quantile_cont(d, 0.1) AS p10, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.9) AS p90 FROM c GROUP BY GROUPING SETS ((class), ())", "mean std p10 median p90")
def r_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution per class and in total, by grouping sets."""
    return R.distribution_with_total(_displaced(spark, sf_dir).withColumn("class", F.col("delta") % 2), "d", "class")


_VARIANTS = ["reference", "trial", "tied"]
_START = "1992-06-01"


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    nw = nation_week(spark, sf_dir)
    trial = F.col("activity") * 0.75 + F.lag("activity").over(T.series()) * 0.25
    return nw.select("symbol", "ts", "eligible", "open", F.col("activity").alias("reference"), trial.alias("trial"), F.floor(F.col("activity") / 3).cast("double").alias("tied"))


def _studied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    panel = _variants(spark, sf_dir)
    labelled = E.forward_labels(panel, [*_HORIZONS], F.expr(f"TIMESTAMP_NTZ '{_END}'"))
    return labelled, R.variant_periods(panel, labelled, _VARIANTS, [*_STEPS], F.expr(f"TIMESTAMP_NTZ '{_START}'"), 20, 5, _WEEK)


_WITHIN = "status IN ('computed', 'rank_ic_unavailable')"

_STUDY = f"""{NATION_WEEK}, nv AS (SELECT symbol, ts, eligible, open, activity AS reference, 0.75::DOUBLE * activity + 0.25::DOUBLE * lag(activity) OVER (PARTITION BY symbol ORDER BY ts) AS trial, floor(activity / 3) AS tied FROM nw),
lv AS ({" UNION ALL ".join(f"""SELECT symbol, ts, eligible, reference, trial, tied, {h} AS horizon, CASE WHEN eligible AND lead(open, 1) OVER w > 0 AND lead(open, {h + 1}) OVER w > 0 THEN lead(open, {h + 1}) OVER w / lead(open, 1) OVER w - 1 END AS forward_return,
    lead(ts, {h + 1}) OVER w IS NULL OR lead(ts, {h + 1}) OVER w >= TIMESTAMP '{_END}' AS purged FROM nv WINDOW w AS (PARTITION BY symbol ORDER BY ts)""" for h in _HORIZONS)}),
bo AS (SELECT lv.*, dl.delta, lv.ts - dl.delta * INTERVAL 7 DAY AS at_, p.eligible AS was, {", ".join(f"p.{v} AS t_{v}" for v in _VARIANTS)} FROM lv CROSS JOIN (SELECT unnest([1, 4]) AS delta) dl LEFT JOIN nv p ON p.symbol = lv.symbol AND p.ts = lv.ts - dl.delta * INTERVAL 7 DAY),
li AS (SELECT *, coalesce(eligible AND was AND NOT purged AND forward_return IS NOT NULL AND {" AND ".join(f"{v} IS NOT NULL AND t_{v} IS NOT NULL" for v in _VARIANTS)}, false) AS live FROM bo),
gd AS (SELECT horizon, delta, ts, min(at_) AS at_, bool_or(was IS NOT NULL) AS there, count(*) FILTER (eligible AND purged) AS out_, count(*) FILTER (live) AS n FROM li GROUP BY 1, 2, 3),
un AS ({" UNION ALL ".join(f"SELECT horizon, delta, ts, '{v}' AS variant, {v} AS now_, t_{v} AS then_, forward_return AS fr FROM li WHERE live" for v in _VARIANTS)}),
rk AS (SELECT *, {avg_rank_sql("now_", "horizon, delta, variant, ts")} AS ra, {avg_rank_sql("then_", "horizon, delta, variant, ts")} AS rb, {avg_rank_sql("fr", "horizon, delta, variant, ts")} AS rr, count(*) OVER (PARTITION BY horizon, delta, variant, ts) AS nn FROM un),
mv AS (SELECT horizon, delta, variant, ts, sum(abs(ra - rb)) / (count(*) * count(*)) AS d, CASE WHEN min(ra) < max(ra) AND min(rr) < max(rr) THEN covar_pop(ra, rr) / (stddev_pop(ra) * stddev_pop(rr)) END AS ic,
  avg(fr) FILTER (least(floor((ra - 1) / nn * 5) + 1, 5) = 5) - avg(fr) FILTER (least(floor((ra - 1) / nn * 5) + 1, 5) = 1) AS spread, count(DISTINCT now_) AS uniq FROM rk GROUP BY 1, 2, 3, 4),
vp AS (SELECT gd.horizon, gd.delta, gd.ts, vs.variant, gd.n, d, CASE WHEN gd.n >= 20 AND uniq >= 5 THEN ic END AS ic, spread, at_, there, out_ FROM gd CROSS JOIN (SELECT unnest({_VARIANTS}) AS variant) vs LEFT JOIN mv ON mv.horizon = gd.horizon AND mv.delta = gd.delta AND mv.ts = gd.ts AND mv.variant = vs.variant),
vt AS (SELECT *, CASE WHEN at_ < TIMESTAMP '{_START}' THEN 'boundary_excluded' WHEN NOT there THEN 'missing_exact_hour' WHEN n < 20 AND out_ > 0 THEN 'label_boundary_excluded' WHEN n < 20 THEN 'insufficient_common_symbols' WHEN ic IS NULL THEN 'rank_ic_unavailable' ELSE 'computed' END AS status FROM vp),
vq AS (SELECT horizon, delta, ts, variant, n, status, CASE WHEN {_WITHIN} THEN d END AS d, CASE WHEN {_WITHIN} THEN ic END AS rank_ic, CASE WHEN {_WITHIN} THEN spread END AS spread FROM vt)"""


def _effects_sql(keys: str, least: int) -> str:
    """CTEs after ``vq`` with more keys: effects against the reference; ends with ``ef``."""
    by = f"{keys}, variant"
    same = lambda p: " AND ".join(f"{p}.{k.strip()} = fb.{k.strip()}" for k in by.split(","))
    effects = ["gain", "ic_change", "spread_change"]
    z = 1.959963984540054
    return f"""rp AS (SELECT *, {", ".join(f"max(CASE WHEN variant = 'reference' THEN {c} END) OVER (PARTITION BY {keys}, ts) AS r_{c}" for c in ("d", "rank_ic", "spread"))} FROM vk),
ps AS (SELECT *, rank_ic IS NOT NULL AND r_rank_ic IS NOT NULL AS ok FROM rp),
pc AS (SELECT *, CASE WHEN ok THEN r_d - d END AS gain, CASE WHEN ok THEN -(rank_ic - r_rank_ic) END AS ic_change, CASE WHEN ok THEN -(spread - r_spread) END AS spread_change FROM ps),
{", ".join(_hac_sql("pc", e, by, 3, least, f"{e[0]}_") for e in effects)},
fb AS (SELECT {by}, count(*) AS periods, count(*) FILTER (ok) AS paired, avg(d) AS mean_d, avg(rank_ic) AS mean_ic, avg(spread) AS mean_spread FROM pc GROUP BY {by}),
eg AS (SELECT fb.*, {", ".join(f"{e[0]}.mean AS {e}, {e[0]}.se AS {e}_se, {e[0]}.mean - {z} * {e[0]}.se AS {e}_low, {e[0]}.mean + {z} * {e[0]}.se AS {e}_high, {e[0]}.status AS {e}_status" for e in effects)} FROM fb {" ".join(f"JOIN {e[0]}_hac {e[0]} ON {same(e[0])}" for e in effects)}),
ef AS (SELECT *, CASE WHEN coalesce(gain_high < 0.001 OR ic_change_high < -0.02, false) THEN 'stop' WHEN coalesce(gain >= 0.001 AND gain_low > 0 AND ic_change_low >= -0.02, false) THEN 'continue' ELSE 'pause' END AS decision FROM eg)"""


_EFFECTS = f"{_STUDY}, vk AS (SELECT * FROM vq), {_effects_sql('horizon, delta', 26)}"
_EFFECT_COLUMNS = "mean_d mean_ic mean_spread " + " ".join(f"{e}{x}" for e in ("gain", "ic_change", "spread_change") for x in ("", "_se", "_low", "_high"))


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.variant_effects(_studied(spark, sf_dir)[1], "reference", -1, 3, 26, 0.001, 0.02)


@query("r_variant_periods", f"WITH {_STUDY} SELECT * FROM vq", "d rank_ic spread")
def r_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D, rank IC and spread of three variants on the observations that all have, with six statuses."""
    return _studied(spark, sf_dir)[1]


@query("r_variant_study", f"WITH {_EFFECTS} SELECT * FROM ef", _EFFECT_COLUMNS)
def r_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired effects of variants against a reference per horizon and step, with intervals and a decision."""
    return _effects(spark, sf_dir)


@query("r_stage_effects", f"WITH {_STUDY}, vk AS (SELECT *, CAST(extract(year FROM ts) AS INTEGER) AS stage FROM vq), {_effects_sql('horizon, delta, stage', 10)} SELECT * FROM ef", _EFFECT_COLUMNS)
def r_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by stage, here the year."""
    periods = _studied(spark, sf_dir)[1].withColumn("stage", F.year("ts"))
    return R.variant_effects(periods, "reference", -1, 3, 10, 0.001, 0.02, ["horizon", "delta", "stage"])


@query(
    "r_variant_coverage",
    f"""WITH {_STUDY}, nc AS ({" UNION ALL ".join(f"SELECT '{v}' AS variant, horizon, count(*) AS grid, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND {v} IS NOT NULL) AS present, count(*) FILTER (eligible AND {v} IS NOT NULL AND NOT purged AND forward_return IS NOT NULL) AS labelled FROM lv GROUP BY horizon" for v in _VARIANTS)})
SELECT *, labelled / nullif(eligible, 0) AS share FROM nc""",
    "share",
)
def r_variant_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each variant covers on its own, per horizon."""
    return R.native_coverage(_studied(spark, sf_dir)[0], _VARIANTS)


@query("r_factor_scan", f"WITH {_EFFECTS} SELECT variant, horizon, delta, paired, mean_d, mean_ic, mean_spread, CAST(row_number() OVER (PARTITION BY horizon, delta ORDER BY round(mean_d, 9), variant) AS INTEGER) AS place FROM ef", "mean_d mean_ic mean_spread")
def r_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D beside IC and spread of each variant over horizons and steps."""
    return R.scan(_effects(spark, sf_dir))


@query(
    "r_effect_grid",
    f"""WITH {_STUDY}, vk AS (SELECT *, CAST(extract(year FROM ts) AS INTEGER) AS stage FROM vq), {_effects_sql('horizon, delta, stage', 10)}, ec AS (SELECT stage, horizon, delta, count(gain) AS n, count(*) FILTER (gain > 0) AS positive, count(*) FILTER (gain < 0) AS negative, count(*) FILTER (gain_low > 0) AS above, count(*) FILTER (gain_high < 0) AS below, avg(gain) AS mean_of_means FROM ef WHERE variant <> 'reference' GROUP BY 1, 2, 3)
SELECT *, above <= positive AND below <= negative AND positive + negative <= n AS consistent FROM ec""",
    "mean_of_means",
)
def r_effect_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects by window, horizon and step: their signs, intervals above and below 0, mean of means, and whether counts agree."""
    periods = _studied(spark, sf_dir)[1].withColumn("stage", F.year("ts"))
    effects = R.variant_effects(periods, "reference", -1, 3, 10, 0.001, 0.02, ["horizon", "delta", "stage"])
    return R.effect_grid(effects.where("variant <> 'reference'"), ["stage", "horizon", "delta"])


@query("r_native_coverage", f"WITH {NATION_WEEK} SELECT CAST(extract(year FROM ts) AS INTEGER) AS year, count(*) AS grid, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND reversal IS NOT NULL) AS present, count(*) FILTER (eligible AND reversal IS NOT NULL) / count(*) AS share FROM nw GROUP BY 1", "share")
def r_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid, eligible and finite shares of a factor."""
    live = F.col("eligible") & F.col("reversal").isNotNull()
    return nation_week(spark, sf_dir).groupBy(F.year("ts").alias("year")).agg(F.count("*").alias("grid"), F.count_if("eligible").alias("eligible"), F.count_if(live).alias("present"), (F.count_if(live) / F.count("*")).alias("share"))


@query(
    "r_front_selection",
    f"""WITH {NATION_WEEK}, s AS (SELECT symbol, CAST(extract(year FROM ts) AS INTEGER) AS parent, round(avg(activity), 3) AS score FROM nw WHERE eligible GROUP BY 1, 2) SELECT parent, symbol, score FROM s QUALIFY row_number() OVER (PARTITION BY parent ORDER BY score, symbol) = 1""",
    "score",
)
def r_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per parent the variant of the lowest mean, ties in a fixed order."""
    return selection.front(nation_week(spark, sf_dir).where("eligible").select(F.year("ts").alias("parent"), "symbol", F.col("activity").alias("score")), "parent", "symbol", "score")


@query(
    "r_transfer_and_effect_grid",
    f"""WITH {_D}, y AS (SELECT delta, CAST(extract(year FROM ts) AS INTEGER) AS year, n_now % 3 AS cell, avg(d) AS mean, avg(d) - 1.96 * stddev_samp(d) / sqrt(count(d)) AS low FROM dp GROUP BY ALL)
SELECT delta, cell, count(*) AS n, count(*) FILTER (mean > 0.1) AS positive, count(*) FILTER (low > 0.1) AS above, avg(mean) AS mean_of_means FROM y GROUP BY delta, cell""",
    "mean_of_means",
)
def r_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of positive effects and intervals above a bound per cell, and means of means."""
    y = _displaced(spark, sf_dir).groupBy("delta", F.year("ts").alias("year"), (F.col("n_now") % 3).alias("cell")).agg(F.avg("d").alias("mean"), (F.avg("d") - 1.96 * F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("low"))
    return y.groupBy("delta", "cell").agg(F.count("*").alias("n"), F.count_if(F.col("mean") > 0.1).alias("positive"), F.count_if(F.col("low") > 0.1).alias("above"), F.avg("mean").alias("mean_of_means"))


@query("r_stratified_pick", "SELECT o_orderpriority AS class, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 6 AS disjoint FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 6")
def r_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of each class by an order, and the sixth as a disjoint sample."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("class"), "o_orderkey", "o_totalprice")
    return selection.disjoint_picks(o, "class", [F.desc("o_totalprice"), "o_orderkey"], 5, 1).drop("o_totalprice")
