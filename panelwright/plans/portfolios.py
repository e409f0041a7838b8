"""Several factors over nations and weeks (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import evaluate as E
from panelwright.operators import ranking as M
from panelwright.plans.base import NATION_WEEK, avg_rank_sql, nation_week, query, table

_FACTORS = ["activity", "momentum", "reversal"]
_CUT = "1998-06-01"

_LONG = f"""{NATION_WEEK}, nl AS (SELECT *, CASE WHEN eligible AND lead(open, 1) OVER w > 0 AND lead(open, 2) OVER w > 0 THEN lead(open, 2) OVER w / lead(open, 1) OVER w - 1 END AS fr FROM nw WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
lg AS ({" UNION ALL ".join(f"SELECT symbol, ts, eligible, fr, '{f}' AS factor, CASE WHEN eligible THEN {f} END AS value FROM nl" for f in _FACTORS)})"""

_ICS = f"""{_LONG}, xy AS (SELECT *, CASE WHEN fr IS NOT NULL THEN value END AS x, CASE WHEN value IS NOT NULL THEN fr END AS y FROM lg), xr AS (SELECT *, {avg_rank_sql("x", "factor, ts")} AS rx, {avg_rank_sql("y", "factor, ts")} AS ry FROM xy),
ics AS (SELECT factor, ts, count(x) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic FROM xr GROUP BY 1, 2 HAVING count(x) >= 20)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = E.forward_labels(nation_week(spark, sf_dir), [1]).withColumn("fr", F.col("forward_return"))
    live = lab.withColumns({f: F.when(F.col("eligible"), F.col(f)) for f in _FACTORS})
    return M.long_factors(live, _FACTORS, ["symbol", "ts", "eligible", "fr"])


def _ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.ic_series(_long(spark, sf_dir), "fr", 20)


@query("m_factor_directions", f"WITH {_ICS} SELECT factor, avg(ic) FILTER (ts < TIMESTAMP '{_CUT}') AS train_ic, avg(ic) FILTER (ts >= TIMESTAMP '{_CUT}') AS test_ic, count(ic) FILTER (ts < TIMESTAMP '{_CUT}') AS train_n, count(ic) FILTER (ts >= TIMESTAMP '{_CUT}') AS test_n, CASE WHEN train_ic < 0 THEN -1 ELSE 1 END AS direction FROM ics GROUP BY factor", "train_ic test_ic")
def m_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: IC per factor before and after a cut, and its direction."""
    return M.directions(_ics(spark, sf_dir), F.expr(f"TIMESTAMP_NTZ '{_CUT}'"))


_WEIGHTS = f"""{_LONG}, wb AS (SELECT * FROM lg WHERE value IS NOT NULL AND fr IS NOT NULL), wr AS (SELECT *, count(*) OVER (PARTITION BY factor, ts) AS n, {avg_rank_sql("value", "factor, ts")} AS rk FROM wb), ws AS (SELECT *, CASE WHEN rk / n > 0.8 THEN 1 WHEN rk / n <= 0.2 THEN -1 END AS side FROM wr WHERE n >= 20),
wt AS (SELECT factor, ts, symbol, side * 0.5::DOUBLE / count(*) OVER (PARTITION BY factor, ts, side) AS weight, fr, max(side) OVER (PARTITION BY factor, ts) - min(side) OVER (PARTITION BY factor, ts) AS spread FROM ws WHERE side IS NOT NULL), wg AS (SELECT factor, ts, symbol, weight, fr AS forward_return FROM wt WHERE spread = 2)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.weights(_long(spark, sf_dir), "fr", 0.2, 20)


@query("m_long_short_weights", f"WITH {_WEIGHTS} SELECT * FROM wg", "weight forward_return")
def m_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: equal weights of the top and bottom fifth by rank."""
    return _weights(spark, sf_dir)


_PATH = f"""{_WEIGHTS}, pe AS (SELECT factor, ts, row_number() OVER (PARTITION BY factor ORDER BY ts) AS k FROM (SELECT DISTINCT factor, ts FROM wg)), nu AS (SELECT wg.*, k FROM wg JOIN pe USING (factor, ts)),
tv AS (SELECT coalesce(a.factor, b.factor) AS factor, coalesce(a.k, b.k + 1) AS k, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) / 2 AS turnover FROM nu a FULL JOIN nu b ON a.factor = b.factor AND a.k = b.k + 1 AND a.symbol = b.symbol GROUP BY 1, 2),
gs AS (SELECT factor, k, ts, sum(weight * forward_return) AS gross FROM nu GROUP BY 1, 2, 3), pa AS (SELECT factor, k, ts, gross, turnover, gross - turnover * 0.001::DOUBLE AS net FROM gs JOIN tv USING (factor, k)),
pth AS (SELECT factor, k, ts, gross, turnover, net, CASE WHEN min(net + 1) OVER w > 0 THEN exp(sum(CASE WHEN net > -1 THEN ln(1 + net) END) OVER w) END AS equity FROM pa WINDOW w AS (PARTITION BY factor ORDER BY ts ROWS UNBOUNDED PRECEDING))"""


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.portfolio(_weights(spark, sf_dir), 0.001)


@query("m_portfolio_path", f"WITH {_PATH} SELECT factor, CAST(k AS INTEGER) AS k, ts, gross, turnover, net, equity FROM pth", "gross turnover net equity")
def m_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: turnover against the valid period before, cost, net return and equity."""
    return _path(spark, sf_dir)


@query(
    "m_path_metrics",
    f"""WITH {_PATH}, dn AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY factor ORDER BY ts ROWS UNBOUNDED PRECEDING), 1) - 1 AS down FROM pth)
SELECT factor, count(*) AS n, CASE WHEN min(net) > -1 THEN exp(avg(CASE WHEN net > -1 THEN ln(1 + net) END) * 52) - 1 END AS annual_return, avg(net) / nullif(stddev_pop(net), 0) * sqrt(52.0::DOUBLE) AS sharpe, min(down) AS max_drawdown, avg(turnover) AS turnover, sum(gross - net) AS cost FROM dn GROUP BY factor""",
    "annual_return sharpe max_drawdown turnover cost",
)
def m_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: annualised return, Sharpe ratio, drawdown, turnover and cost."""
    return M.path_metrics(_path(spark, sf_dir), 52.0, ["factor"])


@query("m_quarterly_stability", f"WITH {_ICS}, q AS (SELECT factor, CAST(extract(year FROM ts) AS INTEGER) AS year, CAST(extract(quarter FROM ts) AS INTEGER) AS quarter, avg(ic) AS mean, count(ic) AS n, avg(CASE WHEN ic IS NOT NULL THEN (round(ic, 12) > 0)::INT END) AS positive_share FROM ics GROUP BY 1, 2, 3) SELECT *, min(mean) OVER (PARTITION BY factor) AS worst FROM q", "mean positive_share worst")
def m_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: IC by quarter and the worst one."""
    return M.stability(_ics(spark, sf_dir))


_OWN = f"""{_LONG}, ob AS (SELECT * FROM lg WHERE value IS NOT NULL AND fr IS NOT NULL), orr AS (SELECT *, {avg_rank_sql("value", "factor, symbol")} AS rx, {avg_rank_sql("fr", "factor, symbol")} AS ry FROM ob), own AS (SELECT factor, symbol, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS ic FROM orr GROUP BY 1, 2)"""


@query("m_time_series_ic", f"WITH {_OWN} SELECT factor, count(ic) AS symbols, avg((ic > 0)::INT) AS positive_share, median(ic) AS median_ic FROM own GROUP BY factor", "positive_share median_ic")
def m_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: each symbol's own rank correlation over time."""
    return M.time_series_ic(_long(spark, sf_dir), "fr")


@query(
    "m_scoreboard",
    f"""WITH {_ICS}, s AS (SELECT factor, round(avg(ic), 9) AS ic_mean, count(ic) AS times, round(-stddev_pop(ic), 9) AS steadiness FROM ics GROUP BY factor),
r AS (SELECT *, {avg_rank_sql("ic_mean", "1")} / count(*) OVER () * 0.6::DOUBLE + {avg_rank_sql("steadiness", "1")} / count(*) OVER () * 0.4::DOUBLE AS score, concat_ws(',', CASE WHEN coalesce(ic_mean < 0.0, true) THEN 'ic_mean' END, CASE WHEN coalesce(times < 100, true) THEN 'times' END) AS failed FROM s)
SELECT factor, ic_mean, times, steadiness, score, failed, failed = '' AS eligible, CAST(row_number() OVER (ORDER BY failed = '' DESC, round(score, 9) DESC, factor) AS INTEGER) AS place FROM r""",
    "ic_mean steadiness score",
)
def m_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: weighted percent ranks, floors that fail, and the order."""
    s = _ics(spark, sf_dir).groupBy("factor").agg(F.round(F.avg("ic"), 9).alias("ic_mean"), F.count("ic").alias("times"), F.round(-F.stddev_pop("ic"), 9).alias("steadiness"))
    return M.scoreboard(s, {"ic_mean": 0.6, "steadiness": 0.4}, {"ic_mean": 0.0, "times": 100})


_SIM = f"""{_LONG}, lv AS (SELECT factor, ts, symbol, value FROM lg WHERE value IS NOT NULL), pt AS (SELECT a.factor AS "left", b.factor AS "right", a.ts, count(*) AS n, CASE WHEN min(a.value) < max(a.value) AND min(b.value) < max(b.value) THEN covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) END AS r FROM lv a JOIN lv b ON a.ts = b.ts AND a.symbol = b.symbol AND a.factor < b.factor GROUP BY 1, 2, 3),
sm AS (SELECT "left", "right", count(*) FILTER (n < 20) AS insufficient, count(*) FILTER (n >= 20 AND r IS NULL) AS constant, count(*) FILTER (n >= 20 AND r IS NOT NULL) AS valid, avg(r) FILTER (n >= 20) AS m FROM pt GROUP BY 1, 2),
sim AS (SELECT "left" AS a, "right" AS b, insufficient, constant, valid, concat_ws(',', CASE WHEN valid < 50 THEN 'too_few_times' END, CASE WHEN constant > 0 THEN 'constant_side' END, CASE WHEN insufficient > 0 THEN 'too_few_symbols' END) AS reasons, CASE WHEN valid >= 50 THEN m END AS mean, 1 - abs(CASE WHEN valid >= 50 THEN m END) AS distance FROM sm)"""


def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.similarity(_long(spark, sf_dir), 20, 50, bucket="year")


@query("m_pairwise_similarity", f"WITH {_SIM} SELECT * FROM sim", "mean distance")
def m_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cross-sectional correlation of each pair of factors, with counts and reasons."""
    return _similarity(spark, sf_dir).withColumnsRenamed({"left": "a", "right": "b"})


@query("m_nearest_factors", f"WITH {_SIM}, bo AS (SELECT a AS factor, b AS other, distance FROM sim UNION ALL SELECT b, a, distance FROM sim) SELECT factor, other, distance, CAST(row_number() OVER (PARTITION BY factor ORDER BY round(distance, 9), other) AS INTEGER) AS place FROM bo WHERE distance <= 0.99 QUALIFY place <= 1", "distance")
def m_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other factor within a distance."""
    return M.nearest(_similarity(spark, sf_dir), 1, 0.99)


@query("m_identical_formulas", "SELECT CAST(o_custkey % 50 AS VARCHAR) AS expanded, min(o_orderkey) AS canonical, count(*) AS members, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sources FROM orders GROUP BY 1")
def m_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: members of one formula folded to the smallest reference, with all sources."""
    o = table(spark, sf_dir, "orders")
    return M.fold_identical(o.select((F.col("o_custkey") % 50).cast("string").alias("expanded"), F.col("o_orderkey").alias("ref"), F.col("o_orderpriority").alias("source")))


@query("m_member_status", f"WITH {_LONG}, t AS (SELECT factor, ts, count(value) AS n, min(value) < max(value) AS varies FROM lg GROUP BY 1, 2), m AS (SELECT factor, CAST(sum(n) AS BIGINT) AS finite, count(*) FILTER (n >= 20) AS times, count(*) FILTER (n >= 20 AND varies) AS varying FROM t GROUP BY 1) SELECT *, CASE WHEN finite = 0 THEN 'no_finite_output' WHEN times < 50 THEN 'too_few_times' WHEN varying = 0 THEN 'constant' WHEN varying < 50 THEN 'too_little_variation' ELSE 'eligible' END AS status FROM m")
def m_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a factor has enough finite and varying cross-sections."""
    return M.member_status(_long(spark, sf_dir), 20, 50)


_USED = {"activity": ["trades"], "momentum": ["close"], "reversal": ["close", "trades"], "dollar": ["close", "volume"]}


@query(
    "m_member_coverage",
    f"""WITH {NATION_WEEK}, c AS (SELECT count(*) FILTER (eligible) AS eligible_rows, {", ".join(f"count(*) FILTER (eligible AND {f} IS NOT NULL) AS {f}" for f in ("close", "volume", "trades"))} FROM nw),
u AS ({" UNION ALL ".join(f"SELECT '{m}' AS member, '{f}' AS field, eligible_rows, {f} AS finite_rows FROM c" for m, fields in _USED.items() for f in fields)}) SELECT *, finite_rows / nullif(eligible_rows, 0) AS ratio FROM u""",
    "ratio",
)
def m_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each field that a factor uses, on eligible rows."""
    members = spark.createDataFrame([*_USED.items()], "member string, fields array<string>")
    return M.member_coverage(nation_week(spark, sf_dir), members, ["close", "volume", "trades"])


@query("m_field_use", "SELECT field, count(*) AS members FROM (SELECT DISTINCT o_orderkey, unnest([o_orderstatus, o_orderpriority, o_orderstatus]) AS field FROM orders) GROUP BY field")
def m_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that use each field."""
    return M.field_use(table(spark, sf_dir, "orders").select(F.array("o_orderstatus", "o_orderpriority", "o_orderstatus").alias("fields")))


_CAL = f"""{_ICS}, yr AS (SELECT factor, CAST(extract(year FROM ts) AS INTEGER) AS year, avg(ic) AS ic, count(ic) AS n FROM ics GROUP BY 1, 2), cal AS (SELECT *, ic - lag(ic) OVER (PARTITION BY factor ORDER BY year) AS change, (sign(ic) = sign(avg(ic) OVER (PARTITION BY factor)))::INTEGER AS same_sign FROM yr)"""


@query("m_ic_calibration", f"WITH {_CAL} SELECT * FROM cal", "ic change")
def m_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly IC, its change and its sign; the directed IC and its parts are in m_directed_calibration."""
    return M.calibration(_ics(spark, sf_dir))


@query("m_threshold_table", f"""WITH {_CAL} SELECT floor_ AS "floor", count(*) FILTER (abs(ic) >= floor_) AS reached, count(*) FILTER (abs(ic) < floor_) AS weak, count(*) FILTER (ic > 0) AS positive FROM cal, (SELECT unnest([0.005::DOUBLE, 0.01::DOUBLE, 0.02::DOUBLE, 0.04::DOUBLE]) AS floor_) GROUP BY floor_""")
def m_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many yearly ICs reach each floor."""
    return M.thresholds(M.calibration(_ics(spark, sf_dir)), [0.005, 0.01, 0.02, 0.04], "ic")


@query("m_ic_quantiles", f"WITH {_CAL} SELECT factor, count(ic) AS n, count(*) FILTER (ic > 0) AS positive, count(*) FILTER (ic < 0) AS negative, min(ic) AS q0, {', '.join(f'quantile_cont(ic, {q / 100}) AS q{q}' for q in (10, 25, 50, 75, 90))}, max(ic) AS q100 FROM cal GROUP BY factor", "q0 q10 q25 q50 q75 q90 q100")
def m_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs and linear quantiles of yearly ICs."""
    return M.value_quantiles(M.calibration(_ics(spark, sf_dir)), "ic", ["factor"])


@query("m_policy_changes", "SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'lost' ELSE 'retained' END AS change FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 1) b ON a.o_orderkey = b.o_orderkey")
def m_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities retained, added and lost."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return M.policy_changes(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 <> 1"), "o_orderkey")


@query("m_family_integrity", "WITH t AS (SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0), f AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 1) SELECT o_custkey, o_orderpriority, 'not_frozen' AS problem FROM t WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.o_custkey = t.o_custkey AND f.o_orderpriority = t.o_orderpriority) UNION ALL SELECT o_custkey, o_orderpriority, 'missing' FROM f WHERE NOT EXISTS (SELECT 1 FROM t WHERE f.o_custkey = t.o_custkey AND f.o_orderpriority = t.o_orderpriority) UNION ALL SELECT o_custkey, o_orderpriority, 'repeated' FROM t GROUP BY ALL HAVING count(*) > 1")
def m_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests outside a frozen family, missing and repeated ones."""
    o = table(spark, sf_dir, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    return M.family_integrity(o.where("o_orderkey % 3 <> 0").select(*keys), o.where("o_orderkey % 3 <> 1").select(*keys).distinct(), keys)
