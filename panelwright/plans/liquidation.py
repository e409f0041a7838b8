"""Liquidation pipeline (L): purchases stand for buys, errors for sells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import liquidations as L
from panelwright.operators import panel as P
from panelwright.plans.base import EV_BARS, USER_UNIVERSE, ev_bars, query, table, user_universe

_SOURCES = """src AS (SELECT event_type AS symbol, user_id % 4 AS source, date_trunc('hour', events.ts) AS hour FROM events WHERE NOT (event_type = 'view' AND user_id % 4 = 2))"""


@query(
    "l_eligible_universe",
    f"""WITH {_SOURCES}, s AS (SELECT symbol, source, min(hour) + source * INTERVAL 3 HOUR AS f, max(hour) AS l FROM src GROUP BY 1, 2)
SELECT symbol, count(*) AS held, max(f) AS start, min(l) AS stop, CASE WHEN count(*) < 4 THEN 'missing_source' WHEN max(f) > min(l) THEN 'no_overlap' ELSE 'eligible' END AS status FROM s GROUP BY symbol""",
)
def l_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: symbols of all four sources, latest start and earliest end."""
    e = table(spark, sf_dir, "events").where("NOT (event_type = 'view' AND user_id % 4 = 2)").select(F.col("event_type").alias("symbol"), (F.col("user_id") % 4).alias("source"), P.hour_of(F.col("ts")).alias("hour"))
    span = e.groupBy("symbol", "source").agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    return L.eligible_universe({f"s{i}": span.where(F.col("source") == i).select("symbol", (F.col("first") + F.expr(f"INTERVAL {3 * i} HOUR")).alias("first"), "last") for i in range(4)})


@query(
    "l_active_symbols",
    f"""WITH {USER_UNIVERSE}, s AS (SELECT symbol, min(ts) + CAST(substr(symbol, 2) AS INTEGER) * INTERVAL 20 HOUR AS start, max(ts) - CAST(substr(symbol, 2) AS INTEGER) * INTERVAL 30 HOUR AS stop FROM us_bars GROUP BY symbol)
SELECT h.ts, count(*) AS active FROM (SELECT DISTINCT ts FROM us_bars) h JOIN s ON h.ts >= s.start AND h.ts <= s.stop GROUP BY h.ts""",
)
def l_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: symbols whose span holds each hour."""
    u = user_universe(spark, sf_dir).where("eligible")
    n = F.substring("symbol", 2, 9).cast("int")
    spans = u.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    spans = spans.select("symbol", (F.col("lo") + F.make_dt_interval(hours=n * 20)).alias("start"), (F.col("hi") - F.make_dt_interval(hours=n * 30)).alias("stop"))
    return L.active(spans.where("start <= stop"), u.select("ts").distinct()).groupBy("ts").agg(F.count("*").alias("active"))


@query(
    "l_object_keys",
    """SELECT exchange, "date", CAST(hour AS INTEGER) AS hour, symbol, kind, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'ex' END AS exchange, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(events.ts AS DATE) END AS "date", CASE WHEN event_id % 9 = 0 THEN NULL ELSE extract(hour FROM events.ts) END AS hour,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'A_' || event_type END AS symbol, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 'liq' END AS kind FROM events) GROUP BY ALL""",
)
def l_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: object keys to their parts; symbols with underscores, and keys that don't fit."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 9 == 0, F.lit("bad/key")).otherwise(F.concat(F.lit("ex/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/"), F.hour("ts"), F.lit("/A_"), F.col("event_type"), F.lit("_liq.tar")))
    return L.parse_keys(e.select(key.alias("object_key"))).groupBy("exchange", "date", "hour", "symbol", "kind").agg(F.count("*").alias("n"))


_RAW = """raw AS (SELECT 'u' || CAST(user_id % 12 AS VARCHAR) AS symbol, events.ts AS event_ts, events.ts + CAST(json_extract_string(props, '$.k') AS INTEGER) * INTERVAL 1 MINUTE AS received_ts, CASE event_type WHEN 'purchase' THEN 'BUY' ELSE 'SELL' END AS side,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN -1.0 ELSE value END AS n, event_id % 3 AS file FROM events WHERE event_type IN ('purchase', 'error'))"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 12).cast("string")).alias("symbol"), F.col("ts").alias("event_ts"),
        (F.col("ts") + F.make_dt_interval(mins=F.get_json_object("props", "$.k").cast("int"))).alias("received_ts"), F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL").alias("side"),
        F.when(i % 13 == 0, None).when(i % 17 == 0, -1.0).otherwise(F.col("value")).alias("price"), F.lit(None).cast("double").alias("average_price"), F.lit(1.0).alias("quantity"), F.lit(None).cast("double").alias("filled_quantity"), (i % 3).alias("file"),
    )


def _hourly_sql(keys: str, where: str = "true") -> str:
    return f"""SELECT {keys}, date_trunc('hour', event_ts) AS ts, count(*) AS events, count(*) FILTER (side = 'SELL') AS long_events, count(*) FILTER (side = 'BUY') AS short_events,
  CASE WHEN count(*) FILTER (side = 'SELL') = 0 THEN 0 ELSE sum(n) FILTER (side = 'SELL' AND n > 0) END AS long_notional, CASE WHEN count(*) FILTER (side = 'BUY') = 0 THEN 0 ELSE sum(n) FILTER (side = 'BUY' AND n > 0) END AS short_notional,
  count(*) FILTER (NOT coalesce(n > 0, false)) AS invalid, min(event_ts) AS "first", max(event_ts) AS "last", max(received_ts) AS received FROM raw WHERE {where} GROUP BY {keys}, date_trunc('hour', event_ts)"""


@query("l_hourly_strict", f"WITH {_RAW} {_hourly_sql('symbol', 'n > 0')}", "long_notional short_notional")
def l_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly totals of events with a valid notional."""
    return L.hourly(_raw(spark, sf_dir), strict=True)


@query("l_hourly_by_file", f"WITH {_RAW} {_hourly_sql('symbol, file')}", "long_notional short_notional")
def l_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per file, invalid notionals counted and left out; NULL where a side has no valid one."""
    return L.hourly(_raw(spark, sf_dir), keys=("symbol", "file"))


_ALIGNED = f"""{USER_UNIVERSE}, {_RAW}, byf AS ({_hourly_sql("symbol, file")}), cov AS (SELECT symbol, ts, CASE WHEN hour(ts) % 4 = 0 THEN 'source_unknown' ELSE 'valid_zero' END AS coverage FROM us_bars),
md AS (SELECT symbol, ts, CAST(sum(events) AS BIGINT) AS events, CAST(sum(long_events) AS BIGINT) AS long_events, CAST(sum(short_events) AS BIGINT) AS short_events, sum(long_notional) AS long_notional, sum(short_notional) AS short_notional, CAST(sum(invalid) AS BIGINT) AS invalid, max(received) AS received, max((file = 2 AND hour(ts) % 5 = 0)::INT) AS mismatch FROM byf GROUP BY 1, 2),
mt AS (SELECT b.symbol, b.ts, b.ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS close_ts, md.* EXCLUDE (symbol, ts), CASE WHEN md.events > 0 THEN 'valid_event' WHEN cov.coverage = 'valid_zero' THEN 'valid_zero' ELSE 'source_unknown' END AS status FROM us_bars b LEFT JOIN cov ON cov.symbol = b.symbol AND cov.ts = b.ts LEFT JOIN md ON md.symbol = b.symbol AND md.ts = b.ts),
al AS (SELECT symbol, ts, status, {", ".join(f"CASE WHEN status = 'valid_zero' THEN coalesce({c}, 0) ELSE {c} END AS {c}" for c in ("events", "long_events", "short_events", "long_notional", "short_notional"))}, coalesce(invalid, 0) AS invalid, coalesce(mismatch, 0) AS mismatch, greatest(close_ts, coalesce(received, close_ts)) AS available_at FROM mt)"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = user_universe(spark, sf_dir).where("eligible").select("symbol", "ts", F.expr("ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND").alias("close_ts"))
    coverage = bars.select("symbol", "ts", F.when(F.hour("ts") % 4 == 0, "source_unknown").otherwise("valid_zero").alias("coverage"))
    off = (F.col("file") == 2) & (F.hour("ts") % 5 == 0)
    by_file = L.hourly(_raw(spark, sf_dir), keys=("symbol", "file")).withColumn("file_ts", F.when(off, F.expr("ts + INTERVAL 1 HOUR")).otherwise(F.col("ts")))
    return L.align(by_file, bars, coverage)


@query("l_align", f"WITH {_ALIGNED} SELECT * FROM al", "long_notional short_notional")
def l_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per bar, coverage repaired, zeros only where known, and when they were known."""
    return _aligned(spark, sf_dir)


_USABLE = f"""{_ALIGNED}, f AS (SELECT *, status IN ('valid_event', 'valid_zero') AS known, coalesce(available_at <= ts + INTERVAL 90 MINUTE, false) AS on_time, coalesce(events = long_events + short_events, false) AS counted FROM al),
us AS (SELECT symbol, ts, status, known AND on_time AND counted AS count_usable, known AND on_time AND counted AND invalid = 0 AND coalesce(long_notional >= 0 AND short_notional >= 0, false) AS amount_usable, events AS ev, long_notional AS ln, short_notional AS sn, mismatch, available_at, known, on_time, counted FROM f),
uu AS (SELECT *, CASE WHEN NOT known THEN 'source_unknown' WHEN NOT on_time THEN 'late' WHEN NOT counted THEN 'invalid_count' WHEN NOT amount_usable THEN 'invalid_notional' ELSE 'valid' END AS usable_status, CASE WHEN count_usable THEN ev END AS events, CASE WHEN amount_usable THEN ln END AS long_notional, CASE WHEN amount_usable THEN sn END AS short_notional FROM us)"""


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.usable(_aligned(spark, sf_dir), F.expr("ts + INTERVAL 90 MINUTE"))


@query("l_usability", f"WITH {_USABLE} SELECT symbol, ts, status, count_usable, amount_usable, usable_status, events, long_notional, short_notional FROM uu", "long_notional short_notional")
def l_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags, masks and a status by precedence."""
    return _usable(spark, sf_dir).select("symbol", "ts", "status", "count_usable", "amount_usable", "usable_status", "events", "long_notional", "short_notional")


@query(
    "l_alignment_audit",
    f"""WITH {_USABLE} SELECT finding, count(*) AS rows FROM (SELECT 'status_' || usable_status AS finding FROM uu UNION ALL SELECT 'available_before_close' FROM uu WHERE available_at < ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND UNION ALL SELECT 'nonzero_valid_zero' FROM uu WHERE status = 'valid_zero' AND events <> 0 UNION ALL SELECT 'mismatch' FROM uu WHERE mismatch > 0) GROUP BY 1""",
)
def l_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings over aligned rows and counts by status."""
    return L.alignment_audit(_usable(spark, sf_dir))


@query("l_top_unknown_times", f"WITH {_USABLE} SELECT ts, count(*) AS rows FROM uu WHERE usable_status = 'source_unknown' GROUP BY ts ORDER BY rows DESC, ts LIMIT 20")
def l_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 times with most unknown rows."""
    return L.most_frequent(_usable(spark, sf_dir), F.col("usable_status") == "source_unknown", "ts")


@query(
    "l_hourly_coverage",
    f"""WITH {USER_UNIVERSE}, o AS (SELECT DISTINCT symbol, ts FROM us_bars WHERE volume > 20), c AS (SELECT ts, string_agg(DISTINCT CASE WHEN trades % 2 = 0 THEN 'book' ELSE 'trade' END, ',' ORDER BY CASE WHEN trades % 2 = 0 THEN 'book' ELSE 'trade' END) AS kinds FROM us_bars WHERE hour(ts) % 3 <> 0 GROUP BY ts)
SELECT u.symbol, u.ts, c.kinds, CASE WHEN o.ts IS NOT NULL THEN 'valid_event' WHEN c.kinds IS NOT NULL THEN 'valid_zero' ELSE 'source_unknown' END AS coverage FROM us_uni u LEFT JOIN o ON o.symbol = u.symbol AND o.ts = u.ts LEFT JOIN c ON c.ts = u.ts""",
)
def l_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: coverage of each hour by own files, else by companion data."""
    u = user_universe(spark, sf_dir)
    companions = u.where(F.col("eligible") & (F.hour("ts") % 3 != 0)).select("ts", F.when(F.col("trades") % 2 == 0, "book").otherwise("trade").alias("kind"))
    return L.hourly_coverage(u.select("symbol", "ts"), u.where("volume > 20").select("symbol", "ts"), companions).select("symbol", "ts", "kinds", "coverage")


@query(
    "l_ingestion_status",
    f"""WITH {EV_BARS}, d AS (SELECT DISTINCT symbol, CAST(ts AS DATE) AS date FROM ev_bars), x AS (SELECT s.symbol, CAST(t.date AS DATE) AS date FROM (SELECT DISTINCT symbol FROM d) s CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS date) t),
i AS (SELECT x.symbol, x.date, d.date AS indexed, CASE WHEN day(d.date) % 6 <> 0 THEN d.date END AS aligned FROM x LEFT JOIN d ON d.symbol = x.symbol AND d.date = x.date)
SELECT symbol, count(*) AS expected, count(indexed) AS indexed, count(aligned) AS aligned, min(CASE WHEN aligned IS NULL THEN date END) AS next_missing FROM i GROUP BY symbol""",
)
def l_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected dates against what each stage has, and the next missing date."""
    d = ev_bars(spark, sf_dir).select("symbol", F.to_date("ts").alias("date")).distinct()
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-31')) AS date")
    return L.ingestion_status(d.select("symbol").distinct().crossJoin(days), {"indexed": d, "aligned": d.where(F.dayofmonth("date") % 6 != 0)})


@query(
    "l_raw_audit",
    "SELECT event_type AS symbol, count(*) AS objects, CAST(sum(user_id) AS BIGINT) AS bytes, count(*) FILTER (user_id <> user_id + CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END) AS size_mismatches, count(*) FILTER (coalesce(user_id <= 0, true)) AS invalid_objects FROM events GROUP BY 1",
)
def l_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, size mismatches and invalid objects of a manifest."""
    e = table(spark, sf_dir, "events")
    return L.raw_audit(e.select(F.col("event_type").alias("symbol"), F.col("user_id").alias("size"), (F.col("user_id") + F.when(F.col("event_id") % 19 == 0, 1).otherwise(0)).alias("stored_size")))
