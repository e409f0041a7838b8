"""Factor evaluation: forward labels, rank IC, quantile groups, HAC inference, BH correction, verdicts."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.cross import average_rank, correlation
from panelwright.functions.pointwise import div, finite
from panelwright.functions.window import series


def forward_labels(panel: DataFrame, horizons: list[int], end: Column | None = None, price: str = "open") -> DataFrame:
    """``panel`` once per horizon with the next-open forward return.

    ``forward_return`` is open[t+1+H] / open[t+1] - 1, both above zero and the row eligible.
    ``label_start`` and ``label_end`` are the times of the two prices; ``purged`` tells that the
    label reaches ``end`` (the segment's half-open end; without one the time after the last row).
    """
    w = series()
    steps = panel.withColumns({"_entry": F.lead(price, 1).over(w), "label_start": F.lead("ts", 1).over(w)})
    several = steps.withColumns({f"_exit{h}": F.lead(price, h + 1).over(w) for h in horizons} | {f"_end{h}": F.lead("ts", h + 1).over(w) for h in horizons})
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_exit{h}").alias("exit"), F.col(f"_end{h}").alias("label_end")) for h in horizons]))
    long = several.withColumn("_h", each)
    entry, out = F.col("_entry"), F.col("_h.exit")
    value = F.when(F.col("eligible") & (entry > 0) & (out > 0), div(out, entry) - 1)
    late = F.col("_h.label_end").isNull() if end is None else F.col("_h.label_end").isNull() | (F.col("_h.label_end") >= end)
    return long.select(*panel.columns, F.col("_h.horizon").alias("horizon"), "label_start", F.col("_h.label_end").alias("label_end"), value.alias("forward_return"), late.alias("purged"))


def sampled(df: DataFrame, start: Column, every: int, step_seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """Rows at every ``every``-th step from ``start``."""
    steps = (F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / step_seconds
    return df.where(F.pmod(steps.cast("long"), F.lit(every)) == 0)


def quantile_group(rank: Column, n: Column, groups: int) -> Column:
    """Equal-width rank group from 1 on; equal values have one rank and so one group."""
    return F.least(F.floor((rank - 1) / n * groups) + 1, F.lit(groups)).cast("int")


def periods(labelled: DataFrame, factor: str, keys: list[str], groups: int, min_symbols: int, direction: int = 1) -> DataFrame:
    """A row per key and time: eligible, n, status, rank IC, group means and counts, spreads.

    Statuses: purged_boundary, insufficient_cross_section, empty_group_due_to_ties, computed. Times
    come from all rows, so those without a clean value stay. Groups and ranks are taken over rows
    that are eligible, not purged and have both a factor and a return.
    """
    at = [*keys, "ts"]
    clean = F.col("eligible") & ~F.col("purged") & finite(F.col(factor)).isNotNull() & finite(F.col("forward_return")).isNotNull()
    seen = labelled.withColumns({"_x": F.when(clean, F.col(factor)), "_y": F.when(clean, F.col("forward_return"))})
    seen = seen.withColumns({"_rx": average_rank(F.col("_x"), *at), "_ry": average_rank(F.col("_y"), *at), "_n": F.count("_x").over(W.partitionBy(*at))})
    seen = seen.withColumn("_g", quantile_group(F.col("_rx"), F.col("_n"), groups))
    of = lambda g: F.col("_g") == g
    found = seen.groupBy(*at).agg(
        F.count_if("eligible").alias("eligible"), F.count("_x").alias("n"), F.count_if(F.col("purged") & F.col("eligible")).alias("purged"),
        F.countDistinct("_x").alias("distinct"), correlation(F.col("_rx"), F.col("_ry")).alias("_ic"),
        *[F.avg(F.when(of(g), F.col("_y"))).alias(f"group_{g}") for g in range(1, groups + 1)],
        *[F.count_if(of(g)).alias(f"group_{g}_n") for g in range(1, groups + 1)],
    )
    ranked = (F.col("n") >= min_symbols) & (F.col("distinct") >= groups)
    filled = F.lit(True)
    for g in range(1, groups + 1):
        filled = filled & (F.col(f"group_{g}_n") > 0)
    status = F.when(F.col("purged") > 0, "purged_boundary").when(~ranked, "insufficient_cross_section").when(~filled, "empty_group_due_to_ties").otherwise("computed")
    found = found.withColumn("status", status)
    usable = F.col("status").isin("computed", "empty_group_due_to_ties")
    found = found.withColumn("rank_ic", F.when(usable, F.col("_ic")))
    spread = F.when(F.col("status") == "computed", F.col(f"group_{groups}") - F.col("group_1"))
    return found.withColumns({"spread": spread, "directional_spread": spread * direction}).drop("_ic", "distinct")


HAC_PARTS = ("n", "grid_periods", "mean", "std", "status", "se", "ci_low", "ci_high", "statistic")


def hac(df: DataFrame, value: str, keys: list[str], lags: int, min_periods: int, confidence: float = 0.95, ts: str = "ts") -> DataFrame:
    """Mean of a series per key with Newey-West standard error over its full grid of periods.

    A period without a value keeps its slot and scores 0. Bartlett weights, n / (n - 1), normal
    confidence bounds. Statuses: insufficient_evidence, degenerate_variance, estimated.
    """
    return hac_of(df, [value], keys, lags, min_periods, confidence, ts).select(*keys, *[F.col(f"{value}_{p}").alias(p) for p in HAC_PARTS])


def hac_of(df: DataFrame, values: list[str], keys: list[str], lags: int, min_periods: int, confidence: float = 0.95, ts: str = "ts") -> DataFrame:
    """``hac`` of several series in one pass: per key ``VALUE_n``, ``VALUE_mean`` and the other parts of each."""
    each = W.partitionBy(*keys)
    order = each.orderBy(ts)
    rows = df.select(*keys, ts, *[finite(F.col(v)).alias(f"x_{v}") for v in values])
    rows = rows.withColumns({f"u_{v}": F.coalesce(F.col(f"x_{v}") - F.avg(f"x_{v}").over(each), F.lit(0.0)) for v in values})
    rows = rows.withColumns({f"l{k}_{v}": F.lag(f"u_{v}", k).over(order) for v in values for k in range(1, lags + 1)})
    sums = [F.count("*").alias("grid_periods")]
    for v in values:
        x, u = F.col(f"x_{v}"), F.col(f"u_{v}")
        cross = F.sum(u * u)
        for k in range(1, lags + 1):
            cross = cross + F.lit(2 * (1 - k / (lags + 1))) * F.coalesce(F.sum(u * F.col(f"l{k}_{v}")), F.lit(0.0))
        sums += [F.count(x).alias(f"{v}_n"), F.avg(x).alias(f"{v}_mean"), F.stddev_samp(x).alias(f"{v}_std"), cross.alias(f"{v}_total"), (F.min(x) < F.max(x)).alias(f"{v}_varies")]
    found = rows.groupBy(*keys).agg(*sums)
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    out = []
    for v in values:
        n, mean = F.col(f"{v}_n"), F.col(f"{v}_mean")
        variance = F.when(n > 1, F.col(f"{v}_total") / (n * (n - 1)))
        status = F.when(n < min_periods, "insufficient_evidence").when(~F.coalesce(f"{v}_varies", F.lit(False)) | (variance <= 0), "degenerate_variance").otherwise("estimated")
        se = F.when(status == "estimated", F.sqrt(F.greatest(variance, F.lit(0.0))))
        parts = {"n": n, "grid_periods": F.col("grid_periods"), "mean": mean, "std": F.col(f"{v}_std"), "status": status, "se": se, "ci_low": mean - z * se, "ci_high": mean + z * se, "statistic": div(mean, se)}
        out += [parts[p].alias(f"{v}_{p}") for p in HAC_PARTS]
    return found.select(*keys, *out)


# The coefficients of the public rational approximation of erfc, relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def with_p_values(summaries: DataFrame, statistic: str = "statistic") -> DataFrame:
    """Two-sided normal p values of a statistic; NULL without one. Spark has no erfc, so it is approximated."""
    z = F.abs(F.col(statistic)) / F.lit(2.0**0.5)
    t = 1 / (1 + z / 2)
    power = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        power = F.lit(c) + t * power
    return summaries.withColumn("p_value", t * F.exp(power - z * z))


def stages(found: DataFrame, keys: list[str], start: Column, hours: int, direction: int, min_periods: int) -> DataFrame:
    """Per key and stretch of ``hours``: periods, mean IC and spread, whether valid and positive."""
    index = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / (3600 * hours)).cast("int")
    made = found.withColumn("stage", index).groupBy(*keys, "stage").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("rank_ic").alias("n_ic"), F.count("directional_spread").alias("n_spread"),
        F.avg("rank_ic").alias("mean_ic"), F.avg("directional_spread").alias("mean_spread"),
    )
    valid = (F.col("n_ic") >= min_periods) & (F.col("n_spread") >= min_periods)
    return made.withColumn("valid", valid).withColumn("positive", F.col("valid") & (F.col("mean_ic") * direction > 0) & (F.col("mean_spread") > 0))


def summary(found: DataFrame, keys: list[str], groups: int, direction: int) -> DataFrame:
    """Per key: direction shares (an IC that is zero but for rounding has none), group means, mean raw spread, counts of each status."""
    return found.groupBy(*keys).agg(
        F.avg((F.round("rank_ic", 12) * direction > 0).cast("double")).alias("ic_direction_share"), F.avg((F.col("directional_spread") > 0).cast("double")).alias("spread_direction_share"),
        F.avg("spread").alias("spread_mean"), F.avg("rank_ic").alias("ic_mean"), F.sum("eligible").alias("eligible"), F.sum("purged").alias("purged"),
        *[F.avg(f"group_{g}").alias(f"group_{g}") for g in range(1, groups + 1)],
        *[F.count_if(F.col("status") == s).alias(s) for s in ("computed", "purged_boundary", "insufficient_cross_section", "empty_group_due_to_ties")],
    )


def rolling(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Means of IC and spread over the last ``n`` periods, all present."""
    frame = series(*keys).rowsBetween(1 - n, 0)
    mean = lambda c: F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))
    return found.select(*keys, "ts", mean("rank_ic").alias("rolling_ic"), mean("directional_spread").alias("rolling_spread"))


def per_symbol(labelled: DataFrame, factor: str, keys: list[str]) -> DataFrame:
    """Per symbol: clean rows, mean return, mean factor."""
    clean = labelled.where(F.col("eligible") & ~F.col("purged") & F.col(factor).isNotNull() & F.col("forward_return").isNotNull())
    return clean.groupBy(*keys, "symbol").agg(F.count("*").alias("n"), F.avg("forward_return").alias("mean_return"), F.avg(factor).alias("mean_factor"))


def common_support(labelled: DataFrame, factor: str) -> DataFrame:
    """Rows of all horizons cut to the times and symbols whose return is present and unpurged in every horizon."""
    at = W.partitionBy("ts", "symbol")
    good = (~F.col("purged") & F.col("forward_return").isNotNull() & F.col(factor).isNotNull()).cast("int")
    every = labelled.withColumn("_all", F.min(good).over(at) == 1)
    return every.withColumns({"forward_return": F.when(F.col("_all"), F.col("forward_return")), "purged": F.max(F.col("purged").cast("int")).over(at) == 1}).drop("_all")


def benjamini_hochberg(tests: DataFrame, alpha: float, p: str = "p_value", by: str = "test") -> DataFrame:
    """``tests`` with ``q_value`` and ``rejected``. A missing p counts as 1 in the family but is never rejected.

    The batch is one family, so its ranks need all of its rows in one order: a row per test, not per observation.
    """
    filled = tests.withColumn("_p", F.coalesce(p, F.lit(1.0)))
    ranked = filled.withColumns({"_k": F.row_number().over(W.orderBy("_p", by)), "_m": F.count("*").over(W.partitionBy())})
    raw = F.least(F.lit(1.0), F.col("_p") * F.col("_m") / F.col("_k"))
    adjusted = ranked.withColumn("_raw", raw).withColumn("q_value", F.min("_raw").over(W.orderBy("_p", by).rowsBetween(0, W.unboundedFollowing)))
    return adjusted.withColumn("rejected", F.col(p).isNotNull() & (F.col("q_value") <= alpha)).drop("_p", "_k", "_m", "_raw")


def compare(control: DataFrame, trial: DataFrame, keys: list[str], value: str, lags: int, min_periods: int, gain: float) -> DataFrame:
    """Paired difference of two factors' periods on one calendar: continue, stop or pause.

    continue: the interval of the mean difference lies above 0 and the mean reaches ``gain``;
    stop: it lies below 0; pause: neither, or too little evidence.
    """
    a = control.select(*keys, "ts", F.col(value).alias("_a"))
    both = trial.select(*keys, "ts", F.col(value).alias("_b")).join(a, [*keys, "ts"]).withColumn("difference", F.col("_b") - F.col("_a"))
    tested = hac(both, "difference", keys, lags, min_periods)
    decision = F.when(F.col("status") != "estimated", "pause").when((F.col("ci_low") > 0) & (F.col("mean") >= gain), "continue").when(F.col("ci_high") < 0, "stop").otherwise("pause")
    return tested.withColumn("decision", decision)


def admission(tests: DataFrame, direction: int, min_ic: float) -> DataFrame:
    """``tests`` with ``reasons`` (why not admitted), ``admitted`` and a descriptive ``track``."""
    reasons = F.array_compact(F.array(
        F.when(~F.col("rejected"), "not_significant"),
        F.when(F.coalesce(F.col("ic_mean") * direction < min_ic, F.lit(True)), "ic_below_minimum"),
        F.when(F.coalesce(F.col("spread_mean") * direction <= 0, F.lit(True)), "spread_not_positive"),
    ))
    share = F.coalesce("positive_stage_share", F.lit(0.0))
    track = F.when((F.abs("spread_mean") >= 0.001) & (share >= 0.75), "strong").when((F.abs("spread_mean") >= 0.0005) & (share >= 0.5), "steady").otherwise("weak")
    return tests.withColumn("reasons", reasons).withColumns({"admitted": F.size("reasons") == 0, "track": track})


def verdict(tests: DataFrame, retained: DataFrame, by: str = "candidate") -> DataFrame:
    """Per candidate: its admitted horizons that were retained before, and whether there is any."""
    passed = tests.groupBy(by).agg(F.sort_array(F.collect_set(F.when(F.col("admitted"), F.col("horizon")))).alias("passed"))
    kept = retained.groupBy(by).agg(F.sort_array(F.collect_set("horizon")).alias("retained"))
    both = passed.join(kept, by, "left").withColumn("horizons", F.sort_array(F.array_intersect("passed", F.coalesce("retained", F.array().cast("array<int>")))))
    return both.withColumn("validated", F.size("horizons") > 0)


def quality_gate(summaries: DataFrame, target: float, most_ic_loss: float) -> DataFrame:
    """Paired evidence passes if the mean reaches ``target``, its interval lies above 0 and IC isn't lost beyond a bound."""
    return summaries.withColumn("passed", F.coalesce((F.col("mean") >= target) & (F.col("ci_low") > 0) & (F.col("ic_ci_low") >= -most_ic_loss), F.lit(False)))


def incomplete(evidence: DataFrame, required: DataFrame, parts: list[str]) -> DataFrame:
    """Required candidate and horizon pairs that lack a part, or whose valid share isn't in (0, 1]."""
    seen = required.join(evidence, ["candidate", "horizon"], "left")
    lacking = F.array_compact(F.array(*[F.when(F.col(p).isNull(), p) for p in parts], F.when(~F.coalesce((F.col("valid_share") > 0) & (F.col("valid_share") <= 1), F.lit(False)), "valid_share")))
    return seen.select("candidate", "horizon", lacking.alias("lacking")).where(F.size("lacking") > 0)
