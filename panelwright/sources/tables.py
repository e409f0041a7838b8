"""Reading market tables, precedence between sources, quarantine, coverage, appends, paging and sinks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.pointwise import div, finite


def epoch_millis(x: Column) -> Column:
    """Milliseconds from an epoch number of unknown unit: seconds, ms, us or ns by its magnitude."""
    size = F.abs(x)
    return F.when(size >= 10**17, F.floor(x / 10**6)).when(size >= 10**14, F.floor(x / 10**3)).when(size >= 10**11, x).otherwise(x * 1000).cast("long")


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as doubles; what isn't a finite number is NULL."""
    return df.withColumns({c: finite(F.col(c).try_cast("double")) for c in columns})


def load(df: DataFrame, symbols: list[str] | None = None, start: Column | None = None, stop: Column | None = None, ts: str = "ts") -> DataFrame:
    """Rows of some symbols in a half-open range of times; the conditions reach the scan."""
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    if start is not None:
        df = df.where(F.col(ts) >= start)
    return df if stop is None else df.where(F.col(ts) < stop)


def complete(df: DataFrame, as_of: Column, step: str, ts: str = "ts") -> DataFrame:
    """Only bars that have closed by ``as_of``."""
    return df.where(F.col(ts) + F.expr(step) <= as_of)


def events_with_previous(events: DataFrame, start: Column, stop: Column, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Events in ``[start, stop)`` and, per symbol, the last one before; of one time the last loaded stays."""
    once = events.withColumn("_k", F.row_number().over(W.partitionBy("symbol", ts).orderBy(F.desc(order)))).where("_k = 1").drop("_k")
    before = once.where(F.col(ts) < start).groupBy("symbol").agg(F.max_by(F.struct(*once.columns), ts).alias("e")).select("e.*")
    return once.where((F.col(ts) >= start) & (F.col(ts) < stop)).unionByName(before)


def by_precedence(new: DataFrame, legacy: DataFrame, by: str = "symbol") -> DataFrame:
    """The new table's rows; the legacy table's for symbols that the new one doesn't have at all."""
    return new.unionByName(legacy.join(new.select(by).distinct(), by, "left_anti"), allowMissingColumns=True)


def merged(left: DataFrame, right: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """Full outer merge of two tables; of ``shared`` columns the first that isn't NULL."""
    other = right.select(*keys, *[F.col(c).alias(f"_{c}" if c in shared else c) for c in right.columns if c not in keys])
    both = left.join(other, keys, "full")
    return both.withColumns({c: F.coalesce(c, f"_{c}") for c in shared}).drop(*[f"_{c}" for c in shared])


def mask_invalid(df: DataFrame, fields: list[str]) -> DataFrame:
    """Negative and non-finite values as NULL."""
    return df.withColumns({f: F.when(finite(F.col(f)) >= 0, finite(F.col(f))) for f in fields})


def field_report(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: rows, missing, invalid, valid."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields])).alias("e"))
    value = F.col("e.value")
    good = finite(value) >= 0
    return long.groupBy(F.col("e.field").alias("field")).agg(
        F.count("*").alias("rows"), F.count_if(value.isNull()).alias("missing"), F.count_if(value.isNotNull() & ~F.coalesce(good, F.lit(False))).alias("invalid"), F.count_if(good).alias("valid"),
    )


def coverage(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Rows, first and last time per key."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def manifest_coverage(manifest: DataFrame) -> DataFrame:
    """Coverage from file keys ``.../SYMBOL/.../YYYY-MM[-DD]`` and row counts, without reading the files."""
    period = F.regexp_extract("file_key", r"(\d{4}-\d{2}(?:-\d{2})?)\D*$", 1)
    first = F.when(F.length(period) == 7, F.concat(period, F.lit("-01"))).otherwise(period).try_cast("date")
    dated = manifest.withColumns({"symbol": F.regexp_extract("file_key", r"^([^/]+)/", 1), "first": first})
    dated = dated.where("first is not null").withColumn("last", F.when(F.length(period) == 7, F.last_day("first")).otherwise(F.col("first")))
    return dated.groupBy("symbol").agg(F.sum("row_count").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"))


def catalog(tables: dict[str, DataFrame], ts: str = "ts") -> DataFrame:
    """Per dataset: distinct symbols, rows, first and last time."""
    made = [df.agg(F.lit(name).alias("dataset"), F.countDistinct("symbol").alias("symbols"), F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last")) for name, df in tables.items()]
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], load: str) -> DataFrame:
    """Both tables' rows, the last load's for each key."""
    both = old.unionByName(new)
    return both.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(load)))).where("_k = 1").drop("_k")


def quarantine(bars: DataFrame, step_seconds: int = 3600, slack_seconds: int = 5, expected_symbol: str | None = None) -> DataFrame:
    """Bars with ``reasons``: every check that the row fails, an empty array for a sound one.

    Checks: required fields, aligned open, close after open, close no later than the step (a little
    longer is allowed up to ``slack_seconds`` unless it reaches the next bar), positive prices, a bar
    without volume that has trades or the reverse, bounds of high and low, taker volume in total.
    """
    c = F.col
    bars = bars.withColumn("_day", F.floor(c("open_time") / F.lit(86_400_000)))
    # The next bar's opening, in two levels, so that a task has one symbol's day and not all of its bars.
    days = bars.groupBy("symbol", "_day").agg(F.min("open_time").alias("_first")).select(
        c("symbol").alias("_of"), c("_day").alias("_on"), F.lead("_first").over(W.partitionBy("symbol").orderBy("_day")).alias("_later")
    )
    bars = bars.join(days, c("symbol").eqNullSafe(c("_of")) & c("_day").eqNullSafe(c("_on")), "left")
    following = F.coalesce(F.lead("open_time").over(W.partitionBy("symbol", "_day").orderBy("open_time")), c("_later"))
    fields = ["symbol", "open_time", "close_time", "open", "high", "low", "close", "volume", "trades", "taker_volume"]
    complete_row = ~F.greatest(*[c(f).isNull().cast("int") for f in fields]).cast("boolean")
    step = step_seconds * 1000
    over = c("close_time") - c("open_time") - (step - 1)
    traded = c("volume") > 0
    tests = {
        "missing_field": ~complete_row, "wrong_symbol": (c("symbol") != expected_symbol) if expected_symbol else F.lit(False), "unaligned_open": F.pmod(c("open_time"), F.lit(step)) != 0,
        "close_before_open": c("close_time") <= c("open_time"), "extended_close": over > slack_seconds * 1000, "overlaps_next": (over > 0) & (c("close_time") >= following),
        "nonpositive_price": F.least(c("open"), c("high"), c("low"), c("close")) <= 0, "inconsistent_zero_volume": (traded & (c("trades") == 0)) | (~traded & (c("trades") > 0)),
        "negative_trades": c("trades") < 0, "high_low_bounds": (c("high") < F.greatest("open", "close")) | (c("low") > F.least("open", "close")), "taker_above_total": c("taker_volume") > c("volume") * (1 + 1e-12),
    }
    return bars.withColumn("reasons", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items()]))).drop("_day", "_of", "_on", "_later")


def quality(bars: DataFrame, ts: str = "ts", step_seconds: int = 3600) -> DataFrame:
    """Per symbol: bars, duplicates, missing bars within the span, gaps, the largest gap, bars out of bounds.

    Bars are compared with the one before within a symbol's day; from day to day, each day is one row.
    """
    c = F.col
    days = bars.withColumn("_s", F.unix_seconds(c(ts).cast("timestamp"))).withColumn("_day", F.floor(c("_s") / F.lit(86400)))
    stepped = days.withColumn("_gap", (c("_s") - F.lag("_s").over(W.partitionBy("symbol", "_day").orderBy("_s"))) / step_seconds)
    out_of_bounds = (c("high") < F.greatest("open", "close")) | (c("low") > F.least("open", "close"))
    wide = lambda gap: F.when(gap > 1, gap - 1)
    daily = stepped.groupBy("symbol", "_day").agg(
        F.count("*").alias("_n"), F.count_if(c("_s").isNotNull() & F.coalesce(c("_gap") > 0, F.lit(True))).alias("_times"), F.min("_s").alias("_first"), F.max("_s").alias("_last"),
        F.count_if(c("_gap") > 1).alias("_gaps"), F.max(wide(c("_gap"))).alias("_largest"), F.count_if(out_of_bounds).alias("_out"),
    )
    daily = daily.withColumn("_gap", (c("_first") - F.lag("_last").over(W.partitionBy("symbol").orderBy("_day"))) / step_seconds)
    return daily.groupBy("symbol").agg(
        F.sum("_n").alias("bars"), (F.sum("_n") - F.sum("_times")).alias("duplicates"), (((F.max("_last") - F.min("_first")) / step_seconds).cast("long") + 1 - F.sum("_times")).alias("missing"),
        (F.sum("_gaps") + F.count_if(c("_gap") > 1)).alias("gaps"), F.coalesce(F.greatest(F.max("_largest"), F.max(wide(c("_gap")))), F.lit(0)).cast("long").alias("largest_gap"), F.sum("_out").alias("out_of_bounds"),
    )


def close_quality(bars: DataFrame, step_seconds: int = 3600, slack: float = 1e-8) -> DataFrame:
    """Per symbol: bars that close short of their step or beyond it, and bars whose takers' mean price lies outside the bar.

    ``bars``: ``open_time`` and ``close_time`` in milliseconds, ``high``, ``low``, and the takers'
    base and quote volume. A bar without taker volume has no such price.
    """
    over = F.col("close_time") - F.col("open_time") - (step_seconds * 1000 - 1)
    price = div(F.col("taker_quote"), F.when(F.col("taker_base") > 0, F.col("taker_base")))
    outside = (price < F.col("low") * (1 - slack)) | (price > F.col("high") * (1 + slack))
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(over < 0).alias("short_closes"), F.count_if(over > 0).alias("extended_closes"), F.count_if(outside).alias("taker_outside"), F.count(price).alias("taker_priced"))


def windowed_csv(spark: SparkSession, path: str, schema: str, start: str, stop: str, symbols: list[str] | None = None, ts: str = "ts", symbol: str = "symbol") -> DataFrame:
    """Rows of CSV files within ``[start, stop)`` and of the symbols, if any are named; the condition goes to the reader."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    kept = rows.where((F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{start}'")) & (F.col(ts) < F.expr(f"TIMESTAMP_NTZ '{stop}'")))
    return kept.where(F.col(symbol).isin(symbols)) if symbols else kept


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode alone."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    return f"{(named or f'file://{tempfile.mkdtemp()}').rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stored: list[str] = []


@atexit.register
def _remove() -> None:
    """Takes the tables of this process away when it ends, where they can be reached without Spark."""
    for path in _stored:
        with contextlib.suppress(Exception):
            store, top = fs.FileSystem.from_uri(path)
            store.delete_dir(top)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: for what several parts of a plan start from, and to cut lineage."""
    path = shared_folder(df.sparkSession, "table")
    _stored.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_window(stage: str, bounds: dict[str, tuple[str, str]], warm_hours: int, ts: str = "ts") -> Column:
    """The condition that a time lies in a development stage or its warm-up; the reserved stage C is refused."""
    if stage not in ("A", "B"):
        raise ValueError(f"stage {stage} is reserved")
    start, stop = bounds[stage]
    return (F.col(ts) >= F.expr(f"TIMESTAMP_NTZ '{start}' - INTERVAL {warm_hours} HOUR")) & (F.col(ts) < F.expr(f"TIMESTAMP_NTZ '{stop}'"))


def resolve(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """``df`` with the market symbol and contract multiplier of an alias table; its own symbol and 1 without an entry."""
    named = df.join(aliases.select(F.col("alias").alias("symbol"), "market", "multiplier"), "symbol", "left")
    return named.withColumns({"market": F.coalesce("market", "symbol"), "multiplier": F.coalesce("multiplier", F.lit(1.0))})


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` rows in an order, a top-n report."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def tail_snapshot(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last ``n`` rows in an order, each with the whole frame's number of rows and its first and last ``order[0]``."""
    whole = df.agg(F.count("*").alias("frame_rows"), F.min(order[0]).alias("frame_first"), F.max(order[0]).alias("frame_last"))
    return tail(df, n, order).join(F.broadcast(whole))


def append_only(stored: DataFrame, batch: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """``batch`` with ``outcome``: new for an unknown key, same for known content, conflict for other content."""
    old = stored.select(*keys, F.struct(*content).alias("_old"))
    outcome = F.when(F.col("_old").isNull(), "new").when(F.col("_old").eqNullSafe(F.struct(*content)), "same").otherwise("conflict")
    return batch.join(old, keys, "left").withColumn("outcome", outcome).drop("_old")


def write_report(df: DataFrame, path: str, kind: str = "csv", mode: str = "append") -> None:
    """A report table as CSV, JSON lines or Parquet, appended as a ledger by default."""
    writer = df.write.mode(mode)
    (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).format(kind).save(path)


def read_report(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """All loads of a report that ``write_report`` has appended; texts with quotes, commas and line ends come back whole."""
    reader = spark.read.schema(schema)
    return (reader.option("header", True).option("multiLine", True).option("escape", '"') if kind == "csv" else reader).format(kind).load(path)
