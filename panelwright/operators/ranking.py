"""Many factors: IC series, long-short portfolios, scoreboards, pairwise similarity, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.cross import average_rank, correlation
from panelwright.functions.pointwise import div, finite
from panelwright.operators.evaluate import hac
from panelwright.operators.gram import pair_counts


def long_factors(panel: DataFrame, factors: list[str], keep: list[str]) -> DataFrame:
    """A row per factor: ``factor`` and ``value`` beside ``keep``."""
    return panel.select(*keep, *[F.col(f).cast("double").alias(f) for f in factors]).unpivot(keep, factors, "factor", "value")


def ic_series(long: DataFrame, returns: str, min_symbols: int) -> DataFrame:
    """Rank IC per factor and time with enough clean rows."""
    both = F.col("value").isNotNull() & F.col(returns).isNotNull()
    seen = long.withColumns({"_x": F.when(both, F.col("value")), "_y": F.when(both, F.col(returns))})
    ranked = seen.withColumns({"_rx": average_rank(F.col("_x"), "factor", "ts"), "_ry": average_rank(F.col("_y"), "factor", "ts")})
    return ranked.groupBy("factor", "ts").agg(F.count("_x").alias("n"), correlation(F.col("_rx"), F.col("_ry")).alias("ic")).where(F.col("n") >= min_symbols)


def directions(ics: DataFrame, cut: Column) -> DataFrame:
    """Per factor: mean IC before and from ``cut`` on, and the direction, the sign of the first."""
    train, test = F.col("ts") < cut, F.col("ts") >= cut
    made = ics.groupBy("factor").agg(F.avg(F.when(train, F.col("ic"))).alias("train_ic"), F.avg(F.when(test, F.col("ic"))).alias("test_ic"), F.count_if(train & F.col("ic").isNotNull()).alias("train_n"), F.count_if(test & F.col("ic").isNotNull()).alias("test_n"))
    return made.withColumn("direction", F.when(F.col("train_ic") < 0, -1).otherwise(1))


def weights(long: DataFrame, returns: str, share: float, min_symbols: int) -> DataFrame:
    """Equal long and short weights of the top and bottom ``share`` by rank at each time."""
    both = long.where(F.col("value").isNotNull() & F.col(returns).isNotNull())
    n = F.count("*").over(W.partitionBy("factor", "ts"))
    ranked = both.withColumns({"_n": n, "_p": average_rank(F.col("value"), "factor", "ts") / n}).where(F.col("_n") >= min_symbols)
    side = ranked.withColumn("_side", F.when(F.col("_p") > 1 - share, 1).when(F.col("_p") <= share, -1)).where("_side is not null")
    held = F.count("*").over(W.partitionBy("factor", "ts", "_side"))
    sides = F.size(F.collect_set("_side").over(W.partitionBy("factor", "ts")))
    return side.withColumns({"weight": F.col("_side") * 0.5 / held, "_sides": sides}).where("_sides = 2").select("factor", "ts", "symbol", "weight", F.col(returns).alias("forward_return"))


def portfolio(positions: DataFrame, cost: float) -> DataFrame:
    """Per factor and valid period: gross and net return, turnover against the valid period before, equity.

    Turnover is half the absolute change of weights; periods are numbered, so the one before is a
    join on the number and symbol. Equity is the running product, in logs while it stays above 0.
    """
    periods = positions.select("factor", "ts").distinct().withColumn("k", F.row_number().over(W.partitionBy("factor").orderBy("ts")))
    numbered = positions.join(periods, ["factor", "ts"])
    now = numbered.select("factor", "k", "symbol", F.col("weight").alias("now"))
    before = numbered.select("factor", (F.col("k") + 1).alias("k"), "symbol", F.col("weight").alias("before"))
    moved = now.join(before, ["factor", "k", "symbol"], "full").groupBy("factor", "k").agg((F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))) / 2).alias("turnover"))
    gross = numbered.groupBy("factor", "k", "ts").agg(F.sum(F.col("weight") * F.col("forward_return")).alias("gross"))
    path = gross.join(moved, ["factor", "k"]).withColumn("net", F.col("gross") - F.col("turnover") * cost)
    run = W.partitionBy("factor").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    grows = F.min(F.col("net") + 1).over(run) > 0
    return path.withColumn("equity", F.when(grows, F.exp(F.sum(F.when(F.col("net") > -1, F.log1p("net"))).over(run))))


def path_metrics(path: DataFrame, periods_per_year: float, keys: list[str]) -> DataFrame:
    """Annualised return (NULL after a total loss), Sharpe ratio, largest drawdown, mean turnover and cost per key."""
    run = W.partitionBy(*keys).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    down = path.withColumn("_down", F.col("equity") / F.greatest(F.max("equity").over(run), F.lit(1.0)) - 1)
    return down.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(F.min("net") > -1, F.exp(F.avg(F.log1p("net")) * periods_per_year) - 1).alias("annual_return"),
        (div(F.avg("net"), F.when(F.stddev_pop("net") > 0, F.stddev_pop("net"))) * periods_per_year**0.5).alias("sharpe"), F.min("_down").alias("max_drawdown"),
        F.avg("turnover").alias("turnover"), F.sum(F.col("gross") - F.col("net")).alias("cost"),
    )


def stability(ics: DataFrame) -> DataFrame:
    """Per factor and quarter: mean, count and positive share of IC; ``worst`` is the factor's lowest quarter."""
    made = ics.groupBy("factor", F.year("ts").alias("year"), F.quarter("ts").alias("quarter")).agg(F.avg("ic").alias("mean"), F.count("ic").alias("n"), F.avg((F.round("ic", 12) > 0).cast("int")).alias("positive_share"))
    return made.withColumn("worst", F.min("mean").over(W.partitionBy("factor")))


def time_series_ic(long: DataFrame, returns: str) -> DataFrame:
    """Per factor: the share of symbols whose own rank correlation over time is positive, and the median."""
    both = long.where(F.col("value").isNotNull() & F.col(returns).isNotNull())
    ranked = both.withColumns({"_rx": average_rank(F.col("value"), "factor", "symbol"), "_ry": average_rank(F.col(returns), "factor", "symbol")})
    own = ranked.groupBy("factor", "symbol").agg(correlation(F.col("_rx"), F.col("_ry")).alias("ic"))
    return own.groupBy("factor").agg(F.count("ic").alias("symbols"), F.avg((F.col("ic") > 0).cast("int")).alias("positive_share"), F.median("ic").alias("median_ic"))


def scoreboard(summaries: DataFrame, parts: dict[str, float], floors: dict[str, float]) -> DataFrame:
    """Weighted percent ranks of ``parts``, the floors that fail, eligibility, and the order: eligible first, then by score."""
    n = F.count("*").over(W.partitionBy())
    ranked = summaries.withColumns({f"_{c}": average_rank(F.col(c), F.lit(1)) / n for c in parts})
    score = sum((F.coalesce(f"_{c}", F.lit(0.0)) * weight for c, weight in parts.items()), F.lit(0.0))
    failed = F.concat_ws(",", *[F.when(F.coalesce(F.col(c) < floor, F.lit(True)), c) for c, floor in floors.items()])
    made = ranked.withColumns({"score": score, "failed": failed}).withColumn("eligible", F.col("failed") == "").drop(*[f"_{c}" for c in parts])
    return made.withColumn("place", F.row_number().over(W.orderBy(F.desc("eligible"), F.desc(F.round("score", 9)), "factor")))


def similarity(long: DataFrame, min_symbols: int, min_periods: int, bucket: str = "week") -> DataFrame:
    """Per pair of factors: the mean over times of their cross-sectional correlation, and distance 1 - |mean|.

    Both sides are taken on the symbols that have both. Times are counted as insufficient (too few
    symbols), constant (a side doesn't vary) or valid; a pair without any common cell has none. The
    correlations of a time come from blocked Gram sums; a task has a ``bucket`` of time of two blocks.
    """
    made = pair_counts(long, min_symbols, bucket)
    all_pairs = long.agg(F.sort_array(F.collect_set("factor")).alias("all")).select(F.explode("all").alias("left"), "all").select("left", F.explode(F.filter("all", lambda x: x > F.col("left"))).alias("right"))
    found = all_pairs.join(made, ["left", "right"], "left").fillna(0, ["insufficient", "constant", "valid"])
    mean = F.when(F.col("valid") >= min_periods, F.try_divide("total", "valid"))
    reasons = F.concat_ws(",", F.when(F.col("valid") < min_periods, "too_few_times"), F.when(F.col("constant") > 0, "constant_side"), F.when(F.col("insufficient") > 0, "too_few_symbols"))
    return found.withColumns({"mean": mean, "distance": 1 - F.abs(mean), "reasons": reasons}).drop("total")


def nearest(pairs: DataFrame, k: int, cut: float) -> DataFrame:
    """Each factor's ``k`` nearest others within a distance."""
    both = pairs.select(F.col("left").alias("factor"), F.col("right").alias("other"), "distance").unionByName(pairs.select(F.col("right").alias("factor"), F.col("left").alias("other"), "distance"))
    near = both.where(F.col("distance") <= cut)
    return near.withColumn("place", F.row_number().over(W.partitionBy("factor").orderBy(F.round("distance", 9), "other"))).where(F.col("place") <= k)


def fold_identical(members: DataFrame, formula: str = "expanded", ref: str = "ref", source: str = "source") -> DataFrame:
    """One row per formula: the smallest reference and all sources."""
    return members.groupBy(formula).agg(F.min(ref).alias("canonical"), F.count("*").alias("members"), F.concat_ws(",", F.sort_array(F.collect_set(source))).alias("sources"))


def member_status(long: DataFrame, min_symbols: int, min_periods: int) -> DataFrame:
    """Per factor: no_finite_output, too_few_times, constant, too_little_variation or eligible."""
    at = long.groupBy("factor", "ts").agg(F.count("value").alias("n"), (F.min("value") < F.max("value")).alias("varies"))
    made = at.groupBy("factor").agg(F.sum("n").alias("finite"), F.count_if(F.col("n") >= min_symbols).alias("times"), F.count_if((F.col("n") >= min_symbols) & F.col("varies")).alias("varying"))
    status = F.when(F.col("finite") == 0, "no_finite_output").when(F.col("times") < min_periods, "too_few_times").when(F.col("varying") == 0, "constant").when(F.col("varying") < min_periods, "too_little_variation").otherwise("eligible")
    return made.withColumn("status", status)


def field_use(members: DataFrame, fields: str = "fields") -> DataFrame:
    """How many members use each field."""
    return members.select(F.explode(F.array_distinct(fields)).alias("field")).groupBy("field").agg(F.count("*").alias("members"))


def calibration(ics: DataFrame) -> DataFrame:
    """Per factor and year: mean IC and how it moved; per factor the share of years with the factor's own sign."""
    yearly = ics.groupBy("factor", F.year("ts").alias("year")).agg(F.avg("ic").alias("ic"), F.count("ic").alias("n"))
    own = F.avg("ic").over(W.partitionBy("factor"))
    return yearly.withColumns({"change": F.col("ic") - F.lag("ic").over(W.partitionBy("factor").orderBy("year")), "same_sign": (F.signum("ic") == F.signum(own)).cast("int")})


def thresholds(values: DataFrame, floors: list[float], value: str) -> DataFrame:
    """At each floor: how many values reach it, fall short, are positive; the floors are a small fixed list."""
    each = values.withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    return each.groupBy("floor").agg(F.count_if(F.abs(value) >= F.col("floor")).alias("reached"), F.count_if(F.abs(value) < F.col("floor")).alias("weak"), F.count_if(F.col(value) > 0).alias("positive"))


def policy_changes(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Identities retained, added and lost between two policies, each once; both sides are counted in one aggregate."""
    sides = old.select(by, F.lit(1).alias("_old"), F.lit(0).alias("_new")).unionByName(new.select(by, F.lit(0).alias("_old"), F.lit(1).alias("_new")))
    held = sides.groupBy(by).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return held.select(by, F.when(F.col("_old") == 0, "added").when(F.col("_new") == 0, "lost").otherwise("retained").alias("change"))


def family_integrity(tests: DataFrame, frozen: DataFrame, keys: list[str]) -> DataFrame:
    """Tests that aren't in the frozen family, frozen ones without a test, and repeated tests."""
    extra = tests.select(*keys).join(frozen, keys, "left_anti").withColumn("problem", F.lit("not_frozen"))
    missing = frozen.select(*keys).join(tests, keys, "left_anti").withColumn("problem", F.lit("missing"))
    repeated = tests.groupBy(*keys).count().where("count > 1").select(*keys).withColumn("problem", F.lit("repeated"))
    return extra.unionByName(missing).unionByName(repeated)


def member_coverage(panel: DataFrame, members: DataFrame, fields: list[str]) -> DataFrame:
    """Per member and field that it uses: eligible rows of the panel, those with a finite value, their ratio.

    The panel is aggregated once over all fields; ``members`` has ``member`` and the array ``fields``.
    """
    counts = panel.agg(F.count_if("eligible").alias("_rows"), *[F.count_if(F.col("eligible") & finite(F.col(f).cast("double")).isNotNull()).alias(f) for f in fields])
    each = counts.select(F.col("_rows").alias("eligible_rows"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("finite_rows")) for f in fields])).alias("f")).select("eligible_rows", "f.*")
    used = members.select("member", F.explode(F.array_distinct("fields")).alias("field"))
    return used.join(F.broadcast(each), "field").select("member", "field", "eligible_rows", "finite_rows", div(F.col("finite_rows"), F.col("eligible_rows")).alias("ratio"))


def directed_calibration(periods: DataFrame, per_symbol: DataFrame, keys: list[str], direction: int, groups: int, lags: int, min_periods: int) -> DataFrame:
    """Per key: directed IC with its interval, share of years with a positive one, adjacent groups in direction, largest symbol's share of observations."""
    tested = hac(periods, "rank_ic", keys, lags, min_periods)
    ends = F.array_sort(F.array(F.col("ci_low") * direction, F.col("ci_high") * direction))
    directed = tested.select(*keys, (F.col("mean") * direction).alias("directed_ic"), ends[0].alias("directed_low"), ends[1].alias("directed_high"), div(F.col("mean") * direction, F.col("std")).alias("icir"))
    yearly = periods.groupBy(*keys, F.year("ts").alias("_year")).agg((F.avg("rank_ic") * direction).alias("_ic"))
    stages = yearly.groupBy(*keys).agg(F.count("_ic").alias("valid_stages"), F.avg((F.col("_ic") > 0).cast("double")).alias("positive_stage_share"))
    means = periods.groupBy(*keys).agg(*[F.avg(f"group_{g}").alias(f"_{g}") for g in range(1, groups + 1)])
    steps = [(F.col(f"_{g + 1}") - F.col(f"_{g}")) * direction for g in range(1, groups)]
    shape = means.select(*keys, sum((F.coalesce((x >= 0).cast("int"), F.lit(0)) for x in steps[1:]), F.coalesce((steps[0] >= 0).cast("int"), F.lit(0))).alias("adjacent_in_direction"), sum((x.isNotNull().cast("int") for x in steps[1:]), steps[0].isNotNull().cast("int")).alias("adjacent_estimable"))
    shares = per_symbol.groupBy(*keys).agg(div(F.max("n"), F.sum("n")).alias("largest_symbol_share"))
    return directed.join(stages, keys).join(shape, keys).join(shares, keys, "left")


def value_quantiles(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Per key: how many values are there, their signs and linear quantiles."""
    points = {"q0": 0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q100": 1}
    return values.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(F.col(value) > 0).alias("positive"), F.count_if(F.col(value) < 0).alias("negative"), *[F.expr(f"percentile({value}, {p})").alias(q) for q, p in points.items()])
