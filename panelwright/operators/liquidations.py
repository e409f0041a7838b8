"""Liquidation events: universe, coverage, hourly totals, alignment, usability, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.pointwise import finite
from panelwright.operators.panel import HOUR, hour_of


def eligible_universe(sources: dict[str, DataFrame]) -> DataFrame:
    """Symbols that every source has, with the latest start and the earliest end; ``status`` tells missing and no_overlap apart.

    Each source is ``(symbol, first, last)``.
    """
    long = None
    for name, df in sources.items():
        part = df.select("symbol", F.lit(name).alias("source"), "first", "last")
        long = part if long is None else long.unionByName(part)
    made = long.groupBy("symbol").agg(F.countDistinct("source").alias("held"), F.max("first").alias("start"), F.min("last").alias("stop"))
    status = F.when(F.col("held") < len(sources), "missing_source").when(F.col("start") > F.col("stop"), "no_overlap").otherwise("eligible")
    return made.withColumn("status", status)


def active(spans: DataFrame, hours: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Symbols active in each hour: ``start <= ts <= stop``.

    Spans are cut into days and met by day, so the containment test runs within a day only.
    """
    days = spans.select(symbol, "start", "stop", F.explode(F.sequence(F.to_date("start"), F.to_date("stop"))).alias("day"))
    return hours.withColumn("day", F.to_date("ts")).join(days, "day").where("ts >= start AND ts <= stop").select("ts", symbol)


def parse_keys(files: DataFrame, key: str = "object_key") -> DataFrame:
    """Exchange, symbol, kind, date and hour from keys ``exchange/date/hour/SYMBOL_kind.ext``; symbols may hold underscores."""
    pattern = r"^([^/]+)/(\d{4}-\d{2}-\d{2})/(\d{1,2})/(.+)_([^_/]+)\.[^./]+$"
    part = lambda i: F.nullif(F.regexp_extract(key, pattern, i), F.lit(""))
    return files.select("*", part(1).alias("exchange"), part(2).try_cast("date").alias("date"), part(3).try_cast("int").alias("hour"), part(4).alias("symbol"), part(5).alias("kind"))


def hourly_coverage(grid: DataFrame, own: DataFrame, companions: DataFrame) -> DataFrame:
    """``grid`` with ``coverage``: valid_event where the symbol has a file, valid_zero where only companions do, else source_unknown.

    ``companions`` counts per hour and names the kinds that were there.
    """
    kinds = companions.groupBy("ts").agg(F.concat_ws(",", F.sort_array(F.collect_set("kind"))).alias("kinds"))
    seen = grid.join(own.select("symbol", "ts").distinct().withColumn("_own", F.lit(True)), ["symbol", "ts"], "left").join(kinds, "ts", "left")
    status = F.when(F.col("_own"), "valid_event").when(F.col("kinds").isNotNull(), "valid_zero").otherwise("source_unknown")
    return seen.withColumn("coverage", status).drop("_own")


def hourly(events: DataFrame, strict: bool = False, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts and notional by side and hour.

    A missing average price or filled quantity falls back to price and quantity. A buy closes a
    short, a sell a long. An invalid notional (not positive) is counted and left out, or the
    ``strict`` form leaves the event out. A side without events sums to 0; a side whose notionals
    are all invalid is NULL.
    """
    price = F.coalesce(finite(F.col("average_price")), finite(F.col("price")))
    quantity = F.coalesce(finite(F.col("filled_quantity")), finite(F.col("quantity")))
    each = events.withColumn("_n", price * quantity).withColumn("_ok", F.coalesce(finite(F.col("_n")) > 0, F.lit(False)))
    if strict:
        each = each.where("_ok")
    side = {"long": F.col("side") == "SELL", "short": F.col("side") == "BUY"}
    total = lambda s: F.when(F.count_if(s) == 0, F.lit(0.0)).otherwise(F.sum(F.when(s & F.col("_ok"), F.col("_n"))))
    return each.groupBy(*keys, hour_of(F.col("event_ts")).alias("ts")).agg(
        F.count("*").alias("events"), F.count_if(side["long"]).alias("long_events"), F.count_if(side["short"]).alias("short_events"),
        total(side["long"]).alias("long_notional"), total(side["short"]).alias("short_notional"), F.count_if(~F.col("_ok")).alias("invalid"),
        F.min("event_ts").alias("first"), F.max("event_ts").alias("last"), F.max("received_ts").alias("received"),
    )


def align(by_file: DataFrame, bars: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per bar: totals over the hour's files, coverage repaired by what is there, zeros only for a known zero, when it was known.

    ``by_file`` has ``hourly`` per file and the file's own hour ``file_ts``; a file in another hour's
    partition is flagged.
    """
    total = lambda c: F.sum(c).alias(c)  # noqa: E731  NULL if no file has a value
    made = by_file.groupBy("symbol", "ts").agg(*map(total, ("events", "long_events", "short_events", "long_notional", "short_notional", "invalid")), F.max("received").alias("received"), F.max((F.col("file_ts") != F.col("ts")).cast("int")).alias("mismatch"))
    met = bars.select("symbol", "ts", "close_ts").join(coverage.select("symbol", "ts", "coverage"), ["symbol", "ts"], "left").join(made, ["symbol", "ts"], "left")
    status = F.when(F.col("events") > 0, "valid_event").when(F.coalesce("coverage", F.lit("source_unknown")) == "valid_zero", "valid_zero").otherwise("source_unknown")
    met = met.withColumn("status", status)
    zero = lambda c: F.when(F.col("status") == "valid_zero", F.coalesce(c, F.lit(0))).otherwise(F.col(c)).alias(c)
    return met.select(
        "symbol", "ts", "status", *map(zero, ("events", "long_events", "short_events", "long_notional", "short_notional")), F.coalesce("invalid", F.lit(0)).alias("invalid"),
        F.coalesce("mismatch", F.lit(0)).alias("mismatch"), F.greatest("close_ts", "received").alias("available_at"),
    )


def structure_faults(aligned: DataFrame, file_symbol: str = "file_symbol") -> DataFrame:
    """``(fault, symbol, ts)`` of aligned rows that a reader must refuse; a sound file has none.

    Faults: repeated_key, symbol_mismatch (the row's symbol isn't its file's), unknown_status,
    off_hour, wrong_close (a bar isn't available at its hour's close), received_after_available,
    and nonzero_valid_zero (an hour known to be empty has values, or lacks the explicit zeros).
    """
    close = F.col("ts") + F.expr("INTERVAL 1 HOUR") - F.expr("INTERVAL 1 MILLISECOND")
    zero = [F.coalesce(F.col(c) != 0, F.lit(True)) for c in ("events", "long_events", "short_events", "long_notional", "short_notional")]
    anything = zero[0]
    for z in zero[1:]:
        anything = anything | z
    faults = {
        "symbol_mismatch": ~F.col("symbol").eqNullSafe(F.col(file_symbol)), "unknown_status": ~F.coalesce(F.col("status").isin("valid_event", "valid_zero", "source_unknown"), F.lit(False)), "off_hour": hour_of(F.col("ts")) != F.col("ts"),
        "wrong_close": ~F.coalesce(F.col("close_ts") == close, F.lit(False)), "received_after_available": F.coalesce(F.col("received") > F.col("available_at"), F.lit(False)), "nonzero_valid_zero": (F.col("status") == "valid_zero") & anything,
    }
    each = aligned.select("symbol", "ts", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in faults.items()]))).alias("fault"))
    again = aligned.groupBy("symbol", "ts").agg(F.count("*").alias("n")).where("n > 1").select("symbol", "ts", F.lit("repeated_key").alias("fault"))
    return each.unionByName(again).select("fault", "symbol", "ts")


def usable(aligned: DataFrame, available_at: Column) -> DataFrame:
    """``aligned`` with count and amount flags, masked values and a status in order of precedence."""
    known = F.col("status").isin("valid_event", "valid_zero")
    on_time = F.coalesce(F.col("available_at") <= available_at, F.lit(False))
    counted = F.coalesce((F.col("events") == F.col("long_events") + F.col("short_events")) & (F.col("events") >= 0), F.lit(False))
    count_ok = known & on_time & counted
    amount_ok = count_ok & (F.col("invalid") == 0) & F.coalesce((F.col("long_notional") >= 0) & (F.col("short_notional") >= 0), F.lit(False))
    state = F.when(~known, "source_unknown").when(~on_time, "late").when(~counted, "invalid_count").when(~amount_ok, "invalid_notional").otherwise("valid")
    return aligned.withColumns({
        "count_usable": count_ok, "amount_usable": amount_ok, "usable_status": state, "events": F.when(count_ok, F.col("events")),
        "long_notional": F.when(amount_ok, F.col("long_notional")), "short_notional": F.when(amount_ok, F.col("short_notional")),
    })


def ingestion_status(expected: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """Per symbol: expected dates, dates that each stage has, and the first date that the last stage lacks."""
    out = expected
    for name, df in stages.items():
        out = out.join(df.select("symbol", "date").distinct().withColumn(name, F.lit(1)), ["symbol", "date"], "left")
    last = [*stages][-1]
    return out.groupBy("symbol").agg(F.count("*").alias("expected"), *[F.count(n).alias(n) for n in stages], F.min(F.when(F.col(last).isNull(), F.col("date"))).alias("next_missing"))


def raw_audit(manifest: DataFrame) -> DataFrame:
    """Totals over an object manifest, and objects whose size differs or that hold nothing."""
    return manifest.groupBy("symbol").agg(
        F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.count_if(F.col("size") != F.col("stored_size")).alias("size_mismatches"), F.count_if(F.coalesce(F.col("size") <= 0, F.lit(True))).alias("invalid_objects"),
    )


def alignment_audit(usable_rows: DataFrame) -> DataFrame:
    """``(finding, rows)``: availability before the close, negative amounts, known zeros that aren't, and counts by status."""
    broken = {
        "available_before_close": F.col("available_at") < F.col("ts") + F.expr(HOUR) - F.expr("INTERVAL 1 MILLISECOND"), "negative_notional": (F.col("long_notional") < 0) | (F.col("short_notional") < 0),
        "nonzero_valid_zero": (F.col("status") == "valid_zero") & (F.col("events") != 0), "mismatch": F.col("mismatch") > 0,
    }
    named = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in broken.items()], F.concat(F.lit("status_"), F.col("usable_status"))), lambda x: x.isNotNull())
    return usable_rows.select(F.explode(named).alias("finding")).groupBy("finding").agg(F.count("*").alias("rows"))


def alignment_totals(usable_rows: DataFrame) -> DataFrame:
    """Per symbol: rows, usable ones, events, amounts by side, invalid notionals, and rows whose file's hour isn't theirs."""
    return usable_rows.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.count_if("count_usable").alias("counted"), F.count_if("amount_usable").alias("priced"), F.sum("events").alias("events"),
        F.sum("long_notional").alias("long_notional"), F.sum("short_notional").alias("short_notional"), F.sum("invalid").alias("invalid"), F.count_if(F.col("mismatch") > 0).alias("mismatches"),
    )


def most_frequent(rows: DataFrame, condition: Column, key: str, n: int = 20) -> DataFrame:
    """The ``n`` keys with most rows that meet a condition, a top-n report."""
    return rows.where(condition).groupBy(key).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), key).limit(n)
