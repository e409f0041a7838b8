"""Streaming jobs over the ``events`` table, and a replay of the table as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelwright.functions.pointwise import finite
from panelwright.functions.window import wilder_index, wilder_means
from panelwright.operators import scan
from panelwright.sources.tables import shared_folder

DELAY = "10 minutes"


def hourly_bars(events: DataFrame) -> DataFrame:
    """Bars per type and hour; an hour comes out once the watermark has passed it."""
    made = events.withWatermark("ts", DELAY).groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.sum("value").alias("volume"), F.count("*").alias("trades"),
    )
    return made.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def late_totals(events: DataFrame) -> DataFrame:
    """Totals per type and hour, with the events counted that were received after the hour's close."""
    hour = F.window("ts", "1 hour")
    received = F.col("ts") + F.make_dt_interval(mins=F.get_json_object("props", "$.k").cast("int"))
    stamped = events.withColumn("received", received).withWatermark("ts", DELAY)
    made = stamped.groupBy(hour, F.col("event_type").alias("symbol")).agg(F.count("*").alias("events"), F.sum("value").alias("notional"), F.count_if(F.col("received") > F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).alias("late"))
    return made.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "events", "notional", "late")


def expiring_join(events: DataFrame) -> DataFrame:
    """Purchases with the same user's views of the six hours before; state older than that is dropped."""
    a = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("u"), "ts").withWatermark("ts", DELAY)
    b = events.where("event_type = 'view'").select(F.col("event_id").alias("view"), F.col("user_id").alias("v"), F.col("ts").alias("seen")).withWatermark("seen", DELAY)
    met = a.join(b, (F.col("u") == F.col("v")) & (F.col("seen") <= F.col("ts")) & (F.col("seen") > F.col("ts") - F.expr("INTERVAL 6 HOURS")))
    return met.select("purchase", "view", F.col("ts").cast("timestamp_ntz").alias("ts"))


class Snapshots(StatefulProcessor):
    """The latest snapshot of a key for every ask, in event time: rows wait until the watermark has passed them.

    State is the snapshot that counts, and the rows still waiting. A timer at the earliest waiting
    row's time takes all rows that the watermark has passed, in order of time, snapshots before the
    asks of the same time. Another one, when the snapshot has expired, forgets it.
    """

    def __init__(self, minutes: int, fields: Sequence[str], ask: str):
        self.expiry, self.fields, self.ask = minutes * 60_000_000, [*fields], ask

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = ", ".join(["micros long", "side int", f"{self.ask} long", *(f"{f} double" for f in self.fields)])
        self.latest = handle.getValueState("latest", row)
        self.waiting = handle.getListState("waiting", row)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            came = [self._plain(r) for r in part[["micros", "side", self.ask, *self.fields]].itertuples(index=False, name=None)]
            self.waiting.appendList(came)
            self._remind(min(r[0] for r in came))
        return iter(())

    def _plain(self, row: tuple[Any, ...]) -> tuple[Any, ...]:
        whole = [None if pd.isna(v) else int(v) for v in row[:3]]
        return *whole, *(None if v is None or not np.isfinite(v) else float(v) for v in row[3:])

    def _remind(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1], tuple((v is not None, v or 0) for v in r[3:]))) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        latest = tuple(self.latest.get()) if self.latest.exists() else None
        found = []
        for row in due:
            if row[1] == 0:
                latest = tuple(row)
            else:
                fresh = latest is not None and row[0] - latest[0] < self.expiry
                values = latest[3:] if fresh else (None,) * len(self.fields)
                there = sum(v is not None for v in values)
                status = "stale" if not fresh else "missing" if not there else "partial" if there < len(values) else "valid"
                found.append((row[2], row[0], *values, status, (row[0] - latest[0]) / 60e6 if fresh else None))
        if later:
            self.waiting.put(later)
            self._remind(later[0][0])
        elif rows:
            self.waiting.clear()
        if latest is not None and (later or passed < latest[0] + self.expiry):
            self.latest.update(latest)
            if not later:
                self._remind(latest[0] + self.expiry)
        elif latest is not None:
            self.latest.clear()
        if found:
            keys = {f"key{i}": [k] * len(found) for i, k in enumerate(key)}
            columns = [self.ask, "micros", *self.fields, "status", "age_minutes"]
            yield pd.DataFrame(keys | dict(zip(columns, zip(*found, strict=True), strict=True)))

    def close(self) -> None:
        pass


def latest_snapshots(asks: DataFrame, snapshots: DataFrame, key: str, ask: str, minutes: int, fields: Sequence[str]) -> DataFrame:
    """Each ask of a stream with its key's latest snapshot so far, if that is younger than ``minutes``: fields, status and age.

    ``asks``: ``(key, ask, ts)``, ``snapshots``: ``(key, ts, fields...)``; both from one stream. The
    whole latest snapshot counts, its nulls included; status is stale, missing, partial or valid, as
    in ``panel.expiring``. An ask comes out once the watermark has passed it. Rows later than the
    watermark are left out by Spark. Needs the state store of RocksDB.
    """
    held = snapshots.select(F.col(key).alias("key0"), "ts", F.lit(0).alias("side"), F.lit(0).cast("long").alias(ask), *[F.col(f).cast("double").alias(f) for f in fields])
    asked = asks.select(F.col(key).alias("key0"), "ts", F.lit(1).alias("side"), F.col(ask).cast("long").alias(ask), *[F.lit(None).cast("double").alias(f) for f in fields])
    both = held.unionByName(asked).withColumn("micros", F.unix_micros("ts")).withWatermark("ts", DELAY)
    schema = f"key0 {dict(both.dtypes)['key0']}, {ask} long, micros long, {', '.join(f'{f} double' for f in fields)}, status string, age_minutes double"
    made = both.groupBy("key0").transformWithStateInPandas(Snapshots(minutes, fields, ask), schema, "Append", "EventTime")
    return made.select(F.col("key0").alias(key), ask, F.timestamp_micros("micros").cast("timestamp_ntz").alias("ts"), *fields, "status", "age_minutes")


_STATE = ("previous", "seen", "gain", "loss")


def _rsi(n: int, keys: Sequence[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: Wilder's means along rows that stand by key and time, all keys of an Arrow batch at once.

    A key's first row has no change, so that it doesn't depend on the key before; what a batch ends
    with is carried into the next one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = (0, 0.0, 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, change, seen0, gain0, loss0 = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "change", "seen", "gain", "loss"))
            fresh, at = np.isnan(change), np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(fresh, at, -1))
            seen = np.where(start < 0, carried[0] + at + 1, at - start + np.nan_to_num(seen0)[start]).astype(np.int64)
            decay = np.where(fresh, 0.0, np.where(seen <= n, 1.0, 1 - 1 / n))
            moves = (np.where(fresh, np.nan_to_num(before), np.maximum(np.nan_to_num(side), 0.0) / n) for before, side in ((gain0, change), (loss0, -change)))
            decay, gain, loss = scan.compose(decay, *moves)
            gain, loss = gain + decay * carried[1], loss + decay * carried[2]
            carried = (int(seen[-1]), float(gain[-1]), float(loss[-1]))
            both = gain + loss
            index = np.where(both == 0, 50.0, 100 * gain / np.where(both == 0, 1.0, both))
            last, old = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("last", "old"))
            state = [pa.array(v, mask=~last | np.isnan(v)) for v in (x, seen.astype(float), gain, loss)]
            rsi = pa.array(index, mask=old | (seen < n) | np.isnan(x))
            named = [*keys, "micros", "rsi", *_STATE, "last", "old"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (*keys, "micros")], rsi, *state, batch.column("last"), batch.column("old")], named)

    return run


def rsi_of_keys(batch: DataFrame, before: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """``(keys, micros, rsi, previous, seen, gain, loss, last, old)`` of a batch that follows the states ``before``.

    A key's ``last`` row holds its state, which is what ``before`` has; ``old`` rows are those states
    themselves. Keys that the batch doesn't have keep theirs. Python sees sorted rows of many keys,
    not a key at a time.
    """
    none = [F.lit(None).cast("double").alias(c) for c in ("seen", "gain", "loss")]
    came = batch.select(*keys, F.unix_micros("ts").alias("micros"), finite(F.col("value").cast("double")).alias("x"), *none, F.lit(False).alias("old"))
    began = before.select(*keys, "micros", F.col("previous").alias("x"), "seen", "gain", "loss", F.lit(True).alias("old"))
    order = W.partitionBy(*keys).orderBy(F.desc("old"), "micros", "x")
    change = F.when(~F.col("old"), F.col("x") - F.lag("x").over(order))
    rows = came.unionByName(began).withColumns({"change": change, "last": F.lead(F.lit(1)).over(order).isNull()})
    kinds = dict(rows.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.mapInArrow(_rsi(n, keys), f"{named}, micros long, rsi double, {', '.join(f'{c} double' for c in _STATE)}, last boolean, old boolean")


def online_rsi(spark: SparkSession, sf_dir: str, n: int = 14, keys: Sequence[str] = ("symbol", "user_id")) -> DataFrame:
    """Wilder's index per event type and user over the events table read as a stream in time order; four numbers are the state of a key.

    Each micro-batch writes its rows and the states of all keys after it, under its number, so that
    a batch that runs again replaces its own. A batch's rows of one key are in one task: with the
    user in the key they are few, however long the stream is.
    """
    place = shared_folder(spark, "rsi")
    events = stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), "user_id", "ts", "value")
    kinds = dict(events.dtypes)
    schema = f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, micros long, rsi double, {', '.join(f'{c} double' for c in _STATE)}, last boolean, old boolean"

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(schema).parquet(f"{place}/{number - 1}").where("last") if number else session.createDataFrame([], schema)
        rsi_of_keys(batch, before, n, keys).write.mode("overwrite").parquet(f"{place}/{number}")

    events.writeStream.foreachBatch(fold).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(schema).parquet(f"{place}/[0-9]*").where("not old")
    return out.select(*keys, F.timestamp_micros("micros").cast("timestamp_ntz").alias("ts"), "rsi")


def rsi_of_batch(batch: DataFrame, before: DataFrame, n: int, keys: Sequence[str], bucket: str = "day") -> tuple[DataFrame, DataFrame]:
    """``(keys, ts, rsi)`` of a batch that follows the state ``before``, and the state after it: ``(keys, ts, x, seen, gain, loss)``, one row a key.

    A key's rows spread over tasks by time; a row without a value starts its index anew. Keys that a
    batch doesn't have keep their state.
    """
    slim = batch.select(*keys, "ts", finite(F.col("value").cast("double")).alias("x"), *[F.lit(None).cast("double").alias(c) for c in ("seen0", "gain0", "loss0")])
    began = before.select(*keys, F.lit("1700-01-01").cast("timestamp").alias("ts"), "x", *[F.col(c).cast("double").alias(f"{c}0") for c in ("seen", "gain", "loss")])
    rows = wilder_means(slim.unionByName(began), n, keys, "ts", bucket)
    after = rows.groupBy(*keys).agg(F.max_by(F.struct("ts", "x", "seen", "gain", "loss"), "ts").alias("s")).select(*keys, "s.*")
    return rows.where("seen0 is null").select(*keys, "ts", wilder_index(n).alias("rsi")), after


def replay_rsi(spark: SparkSession, sf_dir: str, n: int = 14, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Wilder's index per event type over the events table read as a stream, micro-batch after micro-batch.

    A batch continues the state that the batch before has written, one row a key; both output and
    state are written under the batch's number, so that a batch that runs again replaces its own.
    Batches follow one another in time.
    """
    place = shared_folder(spark, "rsi")
    kinds = "symbol string, user_id long"
    named = ", ".join(k for k in kinds.split(", ") if k.split()[0] in keys)
    state = f"{named}, ts timestamp, x double, seen long, gain double, loss double"

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema(state).parquet(f"{place}/state/{number - 1}") if number else session.createDataFrame([], state)
        found, after = rsi_of_batch(batch, before, n, keys)
        after.write.mode("overwrite").parquet(f"{place}/state/{number}")
        found.write.mode("overwrite").parquet(f"{place}/out/{number}")

    events = stream(spark, sf_dir).select(F.col("event_type").alias("symbol"), "user_id", "ts", "value")
    events.writeStream.foreachBatch(fold).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(f"{named}, ts timestamp, rsi double").parquet(f"{place}/out/*")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


_STORE = "spark.sql.streaming.stateStore.providerClass"


def replay(spark: SparkSession, sf_dir: str, job: Callable[[DataFrame], DataFrame], store: str | None = None) -> DataFrame:
    """Runs a job over the events table read as a stream until all of it has been processed; the rows it has put out.

    The sink and the query's state lie in the shared folder that the cluster names in
    ``spark.checkpoint.dir``, or in a temporary one in local mode where that is unset. ``store`` is
    the state store's class for this run alone.
    """
    place = shared_folder(spark, "stream")
    made = job(stream(spark, sf_dir))
    before = spark.conf.get(_STORE)
    try:
        if store:
            spark.conf.set(_STORE, store)
        running = made.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(made.schema).parquet(f"{place}/out")
