"""Rank displacement: how far a factor's cross-sectional ranks move over an exact number of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.cross import average_rank, correlation
from panelwright.functions.pointwise import div
from panelwright.operators.evaluate import hac_of
from panelwright.sources.tables import stored


def pairs(panel: DataFrame, factor: str, steps: list[int], keys: list[str], step_seconds: int = 3600) -> DataFrame:
    """A row per key, step, time and symbol with a value at both ends: ``now`` and ``then``."""
    live = panel.where(F.col("eligible") & F.col(factor).isNotNull()).select(*keys, "symbol", "ts", F.col(factor).alias("now"))
    ask = live.withColumn("delta", F.explode(F.array(*map(F.lit, steps))))
    ask = ask.withColumn("_at", F.col("ts") - F.make_dt_interval(secs=(F.col("delta") * step_seconds).cast("decimal(18,6)")))
    past = live.select(*keys, "symbol", F.col("ts").alias("_at"), F.col("now").alias("then"))
    return ask.join(past, [*keys, "symbol", "_at"]).drop("_at")


def displacement(panel: DataFrame, factor: str, steps: list[int], keys: list[str], min_symbols: int, step_seconds: int = 3600) -> DataFrame:
    """Per key, step and time: symbols, D = sum of rank moves over n squared, ties, coverage, status.

    Ranks at both ends are taken over the symbols that are eligible and finite at both. Statuses:
    boundary_excluded (the earlier time lies before the panel), missing_exact_hour (no row there),
    insufficient_cross_section, computed. Times without a pair stay.
    """
    at = [*keys, "delta", "ts"]
    both = pairs(panel, factor, steps, keys, step_seconds)
    ranked = both.withColumns({"_a": average_rank(F.col("now"), *at), "_b": average_rank(F.col("then"), *at)})
    moved = ranked.groupBy(*at).agg(
        F.count("*").alias("n"), F.sum(F.abs(F.col("_a") - F.col("_b"))).alias("_sum"), (F.count("*") - F.countDistinct("now")).alias("ties_now"), (F.count("*") - F.countDistinct("then")).alias("ties_then"),
    )
    live = F.col("eligible") & F.col(factor).isNotNull()
    counts = panel.groupBy(*keys, "ts").agg(F.count_if(live).alias("n_now"))
    bounds = panel.groupBy(*keys).agg(F.min("ts").alias("_first"))
    grid = counts.withColumn("delta", F.explode(F.array(*map(F.lit, steps))))
    grid = grid.withColumn("_at", F.col("ts") - F.make_dt_interval(secs=(F.col("delta") * step_seconds).cast("decimal(18,6)")))
    grid = grid.join(counts.select(*keys, F.col("ts").alias("_at"), F.col("n_now").alias("n_then")), [*keys, "_at"], "left")
    grid = (grid.join(bounds, keys) if keys else grid.crossJoin(bounds)).join(moved, at, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("_at") < F.col("_first"), "boundary_excluded").when(F.col("n_then").isNull(), "missing_exact_hour").when(F.col("n") < min_symbols, "insufficient_cross_section").otherwise("computed")
    union = F.col("n_now") + F.coalesce("n_then", F.lit(0)) - F.col("n")
    return grid.select(
        *at, "n_now", F.coalesce("n_then", F.lit(0)).alias("n_then"), "n", F.coalesce("ties_now", F.lit(0)).alias("ties_now"), F.coalesce("ties_then", F.lit(0)).alias("ties_then"),
        div(F.col("n"), union).alias("coverage"), status.alias("status"), F.when(status == "computed", F.col("_sum") / (F.col("n") * F.col("n"))).alias("d"),
    )


def distribution(found: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, mean, deviation and exact linear quantiles per key."""
    return found.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.expr(f"percentile({value}, 0.1)").alias("p10"),
        F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.9)").alias("p90"), (F.count(value) / F.count("*")).alias("valid_share"),
    )


def distribution_with_total(found: DataFrame, value: str, by: str) -> DataFrame:
    """The distribution per class and over all, by grouping sets."""
    return found.groupingSets([[by], []], by).agg(
        F.grouping(by).cast("int").alias("is_total"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.expr(f"percentile({value}, 0.1)").alias("p10"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.9)").alias("p90"),
    )


def common_variants(long: DataFrame, value: str = "value") -> DataFrame:
    """A long table of variants cut to the times and symbols at which every variant has a value."""
    n = long.select("variant").distinct().agg(F.count("*").alias("_n"))
    whole = long.where(F.col(value).isNotNull()).groupBy("ts", "symbol").agg(F.countDistinct("variant").alias("_held")).join(F.broadcast(n)).where("_held = _n")
    return long.join(whole.select("ts", "symbol"), ["ts", "symbol"], "left_semi")


def variant_periods(panel: DataFrame, labelled: DataFrame, variants: list[str], steps: list[int], start: Column, min_symbols: int, groups: int, step_seconds: int = 3600) -> DataFrame:
    """Variants of a factor compared on the observations that all of them have: D, rank IC and spread of every period.

    ``panel`` has ``symbol, ts, eligible`` and a column per variant, ``labelled`` the same rows per
    ``horizon`` with ``forward_return`` and ``purged`` (the label leaves the segment, which begins at
    ``start``). A symbol counts at a time if it is eligible there and ``delta`` steps before, every
    variant has a value at both ends, and its label is valid. Per horizon, step, variant and time:
    ``n``, ``status``, ``d``, ``rank_ic``, ``spread``. Statuses, the first that holds:
    boundary_excluded, missing_exact_hour, label_boundary_excluded or insufficient_common_symbols
    (too few symbols), rank_ic_unavailable, computed. The rows of the panel are joined to their past
    once; ranks of all variants share one exchange.
    """
    asks = labelled.select("horizon", "symbol", "ts", "eligible", "purged", "forward_return", *variants, F.explode(F.array(*map(F.lit, steps))).alias("delta"))
    asks = asks.withColumn("_at", F.col("ts") - F.make_dt_interval(secs=(F.col("delta") * step_seconds).cast("decimal(18,6)")))
    past = panel.select("symbol", F.col("ts").alias("_at"), F.col("eligible").alias("_was"), *[F.col(v).alias(f"_then_{v}") for v in variants])
    live = F.col("eligible") & F.coalesce("_was", F.lit(False)) & ~F.col("purged") & F.col("forward_return").isNotNull()
    for v in variants:
        live = live & F.col(v).isNotNull() & F.col(f"_then_{v}").isNotNull()
    both = asks.join(past, ["symbol", "_at"], "left").withColumn("_live", live)
    at = ["horizon", "delta", "ts"]
    grid = both.groupBy(*at).agg(F.min("_at").alias("_at"), F.max(F.col("_was").isNotNull()).alias("_there"), F.count_if(F.col("eligible") & F.col("purged")).alias("_out"), F.count_if("_live").alias("n"))
    ends = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("now"), F.col(f"_then_{v}").alias("then")) for v in variants]))
    rows = both.where("_live").select(*at, "forward_return", ends.alias("v")).select(*at, "forward_return", "v.*")
    keys = [*at, "variant"]
    ranked = rows.withColumns({"_a": average_rank(F.col("now"), *keys), "_b": average_rank(F.col("then"), *keys), "_r": average_rank(F.col("forward_return"), *keys), "_n": F.count("*").over(W.partitionBy(*keys))})
    group = F.least(F.floor((F.col("_a") - 1) / F.col("_n") * groups) + 1, F.lit(groups))
    top, bottom = (F.avg(F.when(group == g, F.col("forward_return"))) for g in (groups, 1))
    moved = ranked.groupBy(*keys).agg(
        (F.sum(F.abs(F.col("_a") - F.col("_b"))) / (F.count("*") * F.count("*"))).alias("_d"), correlation(F.col("_a"), F.col("_r")).alias("_ic"), (top - bottom).alias("_spread"), F.countDistinct("now").alias("_unique"),
    )
    each = grid.withColumn("variant", F.explode(F.array(*map(F.lit, variants)))).join(moved, keys, "left")
    ic = F.when((F.col("n") >= min_symbols) & (F.col("_unique") >= groups), F.col("_ic"))
    status = (
        F.when(F.col("_at") < start, "boundary_excluded").when(~F.col("_there"), "missing_exact_hour")
        .when((F.col("n") < min_symbols) & (F.col("_out") > 0), "label_boundary_excluded").when(F.col("n") < min_symbols, "insufficient_common_symbols")
        .when(ic.isNull(), "rank_ic_unavailable").otherwise("computed")
    )
    within = F.col("status").isin("computed", "rank_ic_unavailable")
    made = each.select(*keys, "n", status.alias("status"), "_d", ic.alias("_ic"), "_spread")
    return made.select(*keys, "n", "status", F.when(within, F.col("_d")).alias("d"), F.when(within, F.col("_ic")).alias("rank_ic"), F.when(within, F.col("_spread")).alias("spread"))


def variant_effects(periods: DataFrame, reference: str, direction: int, lags: int, min_periods: int, min_gain: float, max_ic_loss: float, keys: list[str] | None = None) -> DataFrame:
    """Per horizon, step and variant: means, paired effects against the reference with their errors, and a decision.

    ``gain`` is how much D falls, ``ic_change`` and ``spread_change`` how much the directed IC and
    spread rise, over the periods in which both have an IC. stop: the upper bound of the gain lies
    below ``min_gain``, or that of the IC's change below ``-max_ic_loss``; continue: the gain reaches
    ``min_gain`` with its lower bound above 0 and the IC's lower bound holds; else pause.
    """
    keys = keys or ["horizon", "delta"]
    at = W.partitionBy(*keys, "ts")
    of_reference = lambda c: F.max(F.when(F.col("variant") == reference, F.col(c))).over(at)
    paired = periods.withColumns({f"_{c}": of_reference(c) for c in ("d", "rank_ic", "spread")})
    valid = F.col("rank_ic").isNotNull() & F.col("_rank_ic").isNotNull()
    paired = paired.withColumns({
        "gain": F.when(valid, F.col("_d") - F.col("d")), "ic_change": F.when(valid, (F.col("rank_ic") - F.col("_rank_ic")) * direction), "spread_change": F.when(valid, (F.col("spread") - F.col("_spread")) * direction),
    })
    by, effects = [*keys, "variant"], ["gain", "ic_change", "spread_change"]
    paired = stored(paired.select(*by, "ts", "d", "rank_ic", "spread", valid.alias("valid"), *effects))
    found = paired.groupBy(*by).agg(F.count("*").alias("periods"), F.count_if("valid").alias("paired"), F.avg("d").alias("mean_d"), F.avg("rank_ic").alias("mean_ic"), F.avg("spread").alias("mean_spread"))
    tested = hac_of(paired, effects, by, lags, min_periods)
    named = {"mean": "", "se": "_se", "ci_low": "_low", "ci_high": "_high", "status": "_status"}
    found = found.join(tested.select(*by, *[F.col(f"{e}_{p}").alias(f"{e}{n}") for e in effects for p, n in named.items()]), by)
    stop = (F.col("gain_high") < min_gain) | (F.col("ic_change_high") < -max_ic_loss)
    go = (F.col("gain") >= min_gain) & (F.col("gain_low") > 0) & (F.col("ic_change_low") >= -max_ic_loss)
    no = F.lit(False)
    return found.withColumn("decision", F.when(F.coalesce(stop, no), "stop").when(F.coalesce(go, no), "continue").otherwise("pause"))


def native_coverage(labelled: DataFrame, variants: list[str]) -> DataFrame:
    """Per variant and horizon, each on its own: grid rows, eligible ones, those with a value, and those with a valid label too."""
    long = labelled.select("horizon", "eligible", "purged", "forward_return", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("value")) for v in variants])).alias("v"))
    live = F.col("eligible") & F.col("v.value").isNotNull()
    labels = live & ~F.col("purged") & F.col("forward_return").isNotNull()
    made = long.groupBy(F.col("v.variant").alias("variant"), "horizon").agg(F.count("*").alias("grid"), F.count_if("eligible").alias("eligible"), F.count_if(live).alias("present"), F.count_if(labels).alias("labelled"))
    return made.withColumn("share", div(F.col("labelled"), F.col("eligible")))


def scan(effects: DataFrame) -> DataFrame:
    """A row per factor, horizon and step with its D beside its IC and spread, and its place by D within horizon and step."""
    order = W.partitionBy("horizon", "delta").orderBy(F.round("mean_d", 9), "variant")
    return effects.select("variant", "horizon", "delta", "paired", "mean_d", "mean_ic", "mean_spread", F.row_number().over(order).alias("place"))


def effect_grid(effects: DataFrame, by: list[str]) -> DataFrame:
    """Per cell of ``by``: variants, positive and negative gains, intervals above and below 0, mean of means, and whether the counts agree."""
    made = effects.groupBy(*by).agg(
        F.count("gain").alias("n"), F.count_if(F.col("gain") > 0).alias("positive"), F.count_if(F.col("gain") < 0).alias("negative"), F.count_if(F.col("gain_low") > 0).alias("above"), F.count_if(F.col("gain_high") < 0).alias("below"), F.avg("gain").alias("mean_of_means"),
    )
    return made.withColumn("consistent", (F.col("above") <= F.col("positive")) & (F.col("below") <= F.col("negative")) & (F.col("positive") + F.col("negative") <= F.col("n")))
