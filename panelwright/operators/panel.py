"""Panels: dense grids, point-in-time joins, funding windows, expiring snapshots, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.pointwise import div, finite
from panelwright.operators import scan
from panelwright.sources.tables import stored

HOUR = "INTERVAL 1 HOUR"


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def bars(events: DataFrame, symbol: Column, value: str = "value", ts: str = "ts", bucket: Column | None = None) -> DataFrame:
    """First, highest, lowest and last value, sum and count per symbol and hour (or ``bucket``)."""
    each = events.select(symbol.alias("symbol"), (hour_of(F.col(ts)) if bucket is None else bucket).alias("hour"), F.col(ts).alias("t"), finite(F.col(value)).alias("v"))
    return each.groupBy("symbol", F.col("hour").alias("ts")).agg(
        F.min_by("v", "t").alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", "t").alias("close"),
        F.sum("v").alias("volume"), F.count("*").alias("trades"),
    )


def coarser(hourly: DataFrame, hours: int, start: Column | None = None, stop: Column | None = None) -> DataFrame:
    """Bars of ``hours`` from hourly ones, only of buckets whose every source bar is there.

    ``start`` and ``stop`` (half-open) are widened to whole buckets before the bars are read.
    """
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    wide = lambda t, up: F.timestamp_seconds((F.floor((F.unix_seconds(t.cast("timestamp")) + (hours * 3600 - 1 if up else 0)) / (hours * 3600)) * hours * 3600)).cast("timestamp_ntz")
    if start is not None:
        hourly = hourly.where(F.col("ts") >= wide(start, False))
    if stop is not None:
        hourly = hourly.where(F.col("ts") < wide(stop, True))
    bucket = F.timestamp_seconds(F.floor(epoch / (hours * 3600)) * hours * 3600).cast("timestamp_ntz")
    made = hourly.withColumn("bucket", bucket).groupBy("symbol", "bucket").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("trades").alias("trades"), F.count("*").alias("held"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    whole = (F.col("held") == hours) & (F.col("first") == F.col("bucket")) & (F.col("last") == F.col("bucket") + F.expr(f"INTERVAL {hours - 1} HOUR"))
    return made.where(whole).select("symbol", F.col("bucket").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def dense(df: DataFrame, symbol: str = "symbol", ts: str = "ts", step: str = HOUR) -> DataFrame:
    """Every step from a symbol's first bar to its last; missing bars are rows of NULLs, ``present`` tells them apart."""
    ends = df.groupBy(symbol).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    grid = ends.select(symbol, F.explode(F.sequence("lo", "hi", F.expr(step))).alias(ts))
    return grid.join(df.withColumn("present", F.lit(True)), [symbol, ts], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def universe(df: DataFrame, symbol: str = "symbol", ts: str = "ts", step: str = HOUR) -> DataFrame:
    """Every symbol at every step of the whole range, ``eligible`` where it has a bar."""
    ends = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    times = ends.select(F.explode(F.sequence("lo", "hi", F.expr(step))).alias(ts))
    grid = df.select(symbol).distinct().crossJoin(times)
    return grid.join(df.withColumn("eligible", F.lit(True)), [symbol, ts], "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))


def violations(grid: DataFrame, symbol: str = "symbol", ts: str = "ts", step: str = HOUR) -> DataFrame:
    """``(violation, symbol, ts)`` rows where a grid repeats a key, leaves the hour, lacks a cell or never has a member."""
    keys = grid.select(symbol, ts).distinct()
    repeated = grid.groupBy(symbol, ts).count().where("count > 1").select(F.lit("repeated").alias("violation"), symbol, ts)
    off = grid.where(hour_of(F.col(ts)) != F.col(ts)).select(F.lit("off_hour").alias("violation"), symbol, ts)
    ends = keys.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr(step))).alias(ts))
    lacking = keys.select(symbol).distinct().crossJoin(ends).join(keys, [symbol, ts], "left_anti").select(F.lit("missing").alias("violation"), symbol, ts)
    none = grid.groupBy(symbol).agg(F.max(F.col("eligible").cast("int")).alias("any"), F.min(ts).alias(ts)).where("any = 0 or any is null")
    return repeated.unionByName(off).unionByName(lacking).unionByName(none.select(F.lit("never_eligible").alias("violation"), symbol, ts))


def as_of(left: DataFrame, events: DataFrame, at: str, ts: str, symbol: str = "symbol", payload: str = "event", bucket: str = "day") -> DataFrame:
    """``left`` with the struct of the latest event at or before ``at``: the whole row, its NULLs included.

    Both sides go through one window per symbol and ``bucket`` of time, ordered by time with events
    before the rows that look back at them; what the buckets before hold comes from a window over
    one row per bucket. So one busy symbol is many tasks, there is one shuffle of rows, and no pair
    is formed. Of events at one time the greatest counts; events without a time don't.
    """
    fields = [c for c in events.columns if c != symbol]
    held = events.where(F.col(ts).isNotNull()).select(symbol, F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*fields).alias(payload))
    asks = left.select(symbol, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = held.unionByName(asks, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, "_t")).repartition(symbol, "_bucket")
    order = W.partitionBy(symbol, "_bucket").orderBy("_t", "_side", payload).rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_in", F.last(payload, True).over(order)).where("_side = 1").select(symbol, "_bucket", "_row", "_in")
    last = both.groupBy(symbol, "_bucket").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", payload))).alias("_last"))
    before = W.partitionBy(symbol).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(F.col(symbol).alias("_s"), F.col("_bucket").alias("_b"), F.last("_last", True).over(before)[payload].alias("_before")).where("_before is not null")
    joined = met.join(carried, (met[symbol] == F.col("_s")) & (met["_bucket"] == F.col("_b")), "left")
    return joined.select("_row.*", F.coalesce("_in", "_before").alias(payload))


def attach(base: DataFrame, source: DataFrame, prefix: str, values: list[str], available_at: str = "available_at") -> DataFrame:
    """Values of another bar source at the same symbol and time, visible only once that bar has closed."""
    other = source.select("symbol", "ts", F.col("close_time").alias("_closed"), *[F.col(v).alias(f"_{v}") for v in values])
    seen = base.join(other, ["symbol", "ts"], "left")
    return seen.select(*base.columns, *[F.when(F.col("_closed") <= F.col(available_at), finite(F.col(f"_{v}"))).alias(f"{prefix}_{v}") for v in values])


def rescale(df: DataFrame, multipliers: DataFrame, prices: list[str], volumes: list[str]) -> DataFrame:
    """Prices divided and volumes multiplied by the symbol's contract multiplier (1 without an entry)."""
    by = df.join(multipliers, "symbol", "left").withColumn("_by", F.coalesce("multiplier", F.lit(1.0)))
    return by.withColumns({p: div(F.col(p), F.col("_by")) for p in prices} | {v: F.col(v) * F.col("_by") for v in volumes}).drop("_by", "multiplier")


def funding_window(left: DataFrame, events: DataFrame, hours: int, at: str = "available_at") -> DataFrame:
    """``left`` with ``funding_sum`` over ``(at - hours, at]`` and ``funding_status``; the sum is NULL unless valid.

    With them the latest event so far: ``funding_rate``, ``interval_hours``, ``observed`` (its time)
    and ``funding_age_hours`` (since its settlement).

    ``events``: ``(symbol, event_ts, rate, interval_hours)``. Statuses, the first that holds:
    missing_event (none so far), missing_settlement (a settlement between two events is missing
    inside the window, or the latest is due), invalid_event, insufficient_history, valid. Running
    totals on the events, by day and carried from day to day, and two as-of lookups give each
    window's totals.
    """
    hours_between = F.make_dt_interval(hours=F.col("interval_hours").cast("int"))
    settled = events.select("symbol", "event_ts", hour_of(F.col("event_ts")).alias("settle"), finite(F.col("rate")).alias("rate"), "interval_hours")
    marked = scan.running(scan.bucketed(settled, ["symbol"], "event_ts"), ["symbol"], ["event_ts"], before=("previous", F.col("settle")))
    lost = F.when(F.col("settle") - F.col("before.value") > hours_between, F.col("settle") - hours_between)
    ok = F.col("rate").isNotNull() & (F.col("interval_hours") > 0)
    marked = marked.withColumns({"ok": ok, "gap": lost})
    totals = stored(scan.running(
        marked, ["symbol"], ["event_ts"], rates=("sum", F.when(F.col("ok"), F.col("rate")).otherwise(0.0)), bad=("sum", (~F.col("ok")).cast("int")), lost=("max", F.col("gap")), first=("min", F.col("event_ts")),
    ).drop("before", "gap", "_bucket"))
    low = left.withColumn("_low", F.col(at) - F.make_dt_interval(hours=F.lit(hours)))
    both = as_of(as_of(low, totals, at, "event_ts", payload="now"), totals, "_low", "event_ts", payload="then")
    age = F.col(at) - F.col("now.settle")
    status = (
        F.when(F.col("now").isNull(), "missing_event")
        .when(F.col("now.lost") > F.col("_low"), "missing_settlement")
        .when(~F.col("now.ok"), "invalid_event")
        .when(age >= F.make_dt_interval(hours=F.col("now.interval_hours").cast("int")), "missing_settlement")
        .when(F.col("now.bad") > F.coalesce("then.bad", F.lit(0)), "invalid_event")
        .when(F.col("_low") < F.col("now.first"), "insufficient_history")
        .otherwise("valid")
    )
    summed = F.col("now.rates") - F.coalesce("then.rates", F.lit(0.0))
    latest = {"funding_rate": F.col("now.rate"), "interval_hours": F.col("now.interval_hours"), "observed": F.col("now.event_ts"), "funding_age_hours": (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("now.settle").cast("timestamp"))) / 3600e6}
    return both.withColumn("funding_status", status).withColumns({"funding_sum": F.when(F.col("funding_status") == "valid", summed), **latest}).drop("now", "then", "_low")


def expiring(left: DataFrame, events: DataFrame, minutes: int, fields: list[str], at: str = "available_at") -> DataFrame:
    """``left`` with the latest snapshot's fields, if it is younger than ``minutes``; status stale, missing, partial or valid.

    The whole latest row counts: an older row is never searched for a field that the latest lacks.
    """
    seen = as_of(left, events, at, "event_ts")
    fresh = F.col("event").isNotNull() & (F.col(at) - F.col("event.event_ts") < F.make_dt_interval(mins=F.lit(minutes)))
    there = [finite(F.col(f"event.{f}")).isNotNull().cast("int") for f in fields]
    number = sum(there[1:], there[0])
    status = F.when(F.col("event").isNull() | ~fresh, "stale").when(number == 0, "missing").when(number < len(fields), "partial").otherwise("valid")
    age = F.when(fresh, (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("event.event_ts").cast("timestamp"))) / 60e6)
    return seen.withColumns({**{f: F.when(fresh, finite(F.col(f"event.{f}"))) for f in fields}, "status": status, "age_minutes": age}).drop("event")


def feature_frame(bars: DataFrame, funding: DataFrame, metrics: DataFrame, at: str, fields: list[str]) -> DataFrame:
    """``bars`` with the latest funding event and the latest metrics known at ``at``, such as the bar's open.

    ``funding``: ``(symbol, event_ts, rate, interval_hours)``; an interval that isn't above 0 is NULL.
    Each source keeps its own observation time; a whole latest row counts, its NULLs included.
    """
    both = as_of(as_of(bars, funding, at, "event_ts", payload="_f"), metrics, at, "event_ts", payload="_m")
    hours = F.when(finite(F.col("_f.interval_hours")) > 0, F.col("_f.interval_hours"))
    return both.withColumns({
        "funding_rate": finite(F.col("_f.rate")), "funding_interval_hours": hours, "funding_observed_at": F.col("_f.event_ts"),
        **{f: finite(F.col(f"_m.{f}")) for f in fields}, "metrics_observed_at": F.col("_m.event_ts"),
    }).drop("_f", "_m")


def coverage(df: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Per key and field: rows, valid rows, ratio, eligible rows, eligible rows with a value."""
    long = df.select(*keys, "eligible", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), finite(F.col(f)).alias("value")) for f in fields])).alias("e"))
    return long.groupBy(*keys, F.col("e.field").alias("field")).agg(
        F.count("*").alias("rows"), F.count("e.value").alias("valid"), (F.count("e.value") / F.count("*")).alias("ratio"),
        F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("e.value").isNotNull()).alias("eligible_valid"),
    )


def coverage_rollup(df: DataFrame, fields: list[str], required: DataFrame, market: str = "market", symbol: str = "symbol") -> DataFrame:
    """Eligible rows and eligible rows with a value per market, field and symbol, per market and field, per market, and of all.

    ``level`` is the grouping id: 0 a symbol's field, 1 a market's field, 3 a market, 7 all. Fields with
    an entry in ``required`` ``(field, needed)`` have ``ready`` on their levels: enough eligible values.
    Markets and the whole have the lists of fields that have any eligible value and that have none;
    a list is as long as there are fields.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), finite(F.col(f)).alias("value")) for f in fields]))
    long = df.select(F.col(market).alias("market"), F.col(symbol).alias("symbol"), "eligible", each.alias("e")).select("market", "symbol", "eligible", "e.*")
    counted = long.rollup("market", "field", "symbol").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("rows"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("value").isNotNull()).alias("valid"),
    )
    ready = counted.join(required.select("field", "needed"), "field", "left").withColumn("ready", F.col("valid") >= F.col("needed"))
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("field")))), ",")
    field_levels = counted.where("level = 1")
    by_market = field_levels.groupBy("market").agg(names(F.col("valid") > 0).alias("covered"), names(F.col("valid") == 0).alias("uncovered")).withColumn("level", F.lit(3))
    whole = field_levels.groupBy("field").agg(F.sum("valid").alias("valid")).agg(F.lit(None).cast("string").alias("market"), names(F.col("valid") > 0).alias("covered"), names(F.col("valid") == 0).alias("uncovered")).withColumn("level", F.lit(7))
    lists = by_market.unionByName(whole).select(F.col("market").alias("_m"), F.col("level").alias("_l"), "covered", "uncovered")
    return ready.join(lists, ready["market"].eqNullSafe(F.col("_m")) & (ready["level"] == F.col("_l")), "left").select("level", "market", "field", "symbol", "rows", "eligible", "valid", "needed", "ready", "covered", "uncovered")


def next_bar_panel(df: DataFrame, scale: float = 1.0, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """``df``'s keys with the next bar's open and close and its open-to-close return; rows without one go."""
    w = W.partitionBy(symbol).orderBy(ts)
    each = df.select(symbol, ts, F.lead("open").over(w).alias("next_open"), F.lead("close").over(w).alias("next_close"))
    return each.withColumn("next_return", div(F.col("next_close") * scale, F.col("next_open")) - 1).where("next_return is not null")


def excluded_symbols(asked: DataFrame, bars: DataFrame, panel: DataFrame) -> DataFrame:
    """``(symbol, reason)`` of the symbols asked for that a panel doesn't have: no_bars, or no_next_bar where there are some."""
    there = bars.where("close is not null").select("symbol").distinct().withColumn("_bars", F.lit(True))
    lacking = asked.select("symbol").distinct().join(panel.select("symbol").distinct(), "symbol", "left_anti")
    return lacking.join(there, "symbol", "left").select("symbol", F.when(F.col("_bars"), "no_next_bar").otherwise("no_bars").alias("reason"))


#: Endings of leveraged tokens' names.
LEVERAGED = r"(UP|DOWN|BULL|BEAR)$"


def cohort(markets: dict[str, DataFrame], steps: int, excluded: DataFrame, n: int, volume: str = "volume", period: str = "day") -> DataFrame:
    """The ``n`` symbols with the largest median volume of a period, of those that have all ``steps`` valid bars in every market.

    ``markets``: bars ``(symbol, ts, close, volume)`` of the time before the cut; a bar is valid with a
    close above zero and a volume that isn't negative. Named symbols and leveraged tokens are left
    out. Volumes of the first market count. The median, not the total, ranks: one busy day doesn't.
    """
    names = [*markets]
    valid = {m: df.where((finite(F.col("close")) > 0) & (finite(F.col(volume)) >= 0)) for m, df in markets.items()}
    found = valid[names[0]].groupBy("symbol", F.date_trunc(period, "ts").alias("_p")).agg(F.sum(volume).alias("_v")).groupBy("symbol").agg(F.median("_v").alias("median_volume"))
    for df in valid.values():
        found = found.join(df.groupBy("symbol").agg(F.countDistinct("ts").alias("_n")).where(F.col("_n") == steps).select("symbol"), "symbol", "left_semi")
    found = found.join(excluded, "symbol", "left_anti").where(~F.col("symbol").rlike(LEVERAGED))
    top = found.orderBy(F.desc("median_volume"), "symbol").limit(n)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("median_volume"), "symbol")).cast("long"))


def field_hours(df: DataFrame, fields: list[str], least: int) -> DataFrame:
    """Per field: eligible rows, eligible rows with a value, and times with at least ``least`` such symbols, of all times."""
    each = df.groupBy("ts").agg(F.count_if("eligible").alias("_e"), *[F.count_if(F.col("eligible") & finite(F.col(f).cast("double")).isNotNull()).alias(f) for f in fields])
    long = each.unpivot(["ts", "_e"], fields, "field", "n")
    return long.groupBy("field").agg(F.sum("_e").alias("eligible"), F.sum("n").alias("valid"), F.count_if(F.col("n") >= least).alias("full_times"), F.count("*").alias("times"))


def ranges(df: DataFrame, times: list[str], ages: list[str], keys: list[str]) -> DataFrame:
    """Per key: the first and last of every observed time, the least and greatest of every age; NULL where there is none."""
    ends = [f(c).alias(f"{c}_{n}") for c in times for n, f in (("first", F.min), ("last", F.max))]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *ends, *[f(finite(F.col(c))).alias(f"{c}_{n}") for c in ages for n, f in (("min", F.min), ("max", F.max))])


def validity(x: Column, kind: str) -> Column:
    """A field masked by its unit: prices above zero; amounts, ratios and counts from zero on."""
    ok = {"price": x > 0, "amount": x >= 0, "ratio": x >= 0}.get(kind, F.lit(True))
    return F.when(ok, finite(x))


def reason(x: Column, masked: Column) -> Column:
    """Why a field has no value: missing at the source, or invalid there; NULL where it has one."""
    return F.when(masked.isNotNull(), None).when(finite(x).isNull(), "missing").otherwise("invalid")


def look_ahead(df: DataFrame, observed: list[str], available_at: str = "available_at") -> DataFrame:
    """Rows in which something was observed after the row was available; a sound panel has none."""
    late = F.lit(False)
    for column in observed:
        late = late | F.coalesce(F.col(column) > F.col(available_at), F.lit(False))
    return df.where(late)
