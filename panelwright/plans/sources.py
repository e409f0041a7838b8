"""Sources, coverage and quality (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import panel as P
from panelwright.operators import selection as C
from panelwright.plans.base import EV_BARS, EV_GRID, USER_UNIVERSE, ev_bars, ev_grid, query, table, user_universe
from panelwright.sources import archives as A
from panelwright.sources import tables as S


def _ts(text: str):
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


@query(
    "s_load_complete_bars",
    f"WITH {EV_BARS} SELECT symbol, ts, open, high, low, close, volume, trades FROM ev_bars WHERE symbol IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-19 12:30:00'",
    "open high low close volume",
)
def s_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of some symbols and times, only those closed by a given moment."""
    found = S.load(ev_bars(spark, sf_dir), ["click", "view"], _ts("2024-01-05 00:00:00"), _ts("2024-01-20 00:00:00"))
    return S.complete(found, _ts("2024-01-19 12:30:00"), "INTERVAL 1 HOUR")


@query(
    "s_derive_coarse_bars",
    f"""WITH {EV_BARS}, b AS (SELECT *, to_timestamp(floor(epoch(ts) / 14400) * 14400)::TIMESTAMP AS bucket FROM ev_bars WHERE ts >= TIMESTAMP '2024-01-03 04:00:00' AND ts < TIMESTAMP '2024-01-25 20:00:00')
SELECT symbol, bucket AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, CAST(sum(trades) AS BIGINT) AS trades
FROM b GROUP BY symbol, bucket HAVING count(*) = 4 AND min(ts) = bucket AND max(ts) = bucket + INTERVAL 3 HOUR""",
    "open high low close volume",
)
def s_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-hour bars from complete hourly ones, over a range widened to whole buckets."""
    return P.coarser(ev_bars(spark, sf_dir), 4, _ts("2024-01-03 05:00:00"), _ts("2024-01-25 17:30:00"))


@query(
    "s_coerce_and_epoch",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, epoch_ms(ts) AS from_s, epoch_ms(ts) AS from_us, CAST(NULL AS DOUBLE) AS bad
FROM (SELECT event_id, props, date_trunc('second', ts) AS ts FROM events)""",
)
def s_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to numbers, and epoch numbers of unknown unit to milliseconds."""
    seconds = F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp"))
    raw = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("bad"), seconds.alias("s"))
    return S.numbers(raw, ["k", "bad"]).select("event_id", "k", "bad", S.epoch_millis(F.col("s")).alias("from_s"), S.epoch_millis(F.col("s") * 1_000_000).alias("from_us"))


@query(
    "s_events_with_previous",
    """WITH e AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, event_id, value FROM events), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id DESC) = 1)
SELECT * FROM o WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' UNION ALL SELECT * FROM (SELECT * FROM o WHERE ts < TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)""",
)
def s_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a range and the last one before it, one per minute."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return S.events_with_previous(e, _ts("2024-01-10 00:00:00"), _ts("2024-01-12 00:00:00"))


@query(
    "s_source_precedence",
    """WITH e AS (SELECT event_type AS symbol, event_id, value FROM events), n AS (SELECT * FROM e WHERE symbol IN ('click', 'error') AND event_id % 2 = 0)
SELECT n.symbol, n.event_id, n.value, CASE WHEN n.event_id % 10 = 0 THEN n.value * 2 END AS mark FROM n UNION ALL SELECT symbol, event_id, value, CAST(NULL AS DOUBLE) FROM e WHERE symbol NOT IN (SELECT symbol FROM n)""",
    "value mark",
)
def s_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol's rows come from the new table if it has any there, else from the old; prices filled from a left join."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "event_id", "value")
    new = e.where(F.col("symbol").isin("click", "error") & (F.col("event_id") % 2 == 0))
    marks = e.where(F.col("event_id") % 10 == 0).select("symbol", "event_id", (F.col("value") * 2).alias("mark"))
    return S.by_precedence(new.join(marks, ["symbol", "event_id"], "left"), e)


@query(
    "s_full_outer_metrics",
    """WITH a AS (SELECT event_type AS symbol, event_id, value AS interest, 'a' AS source FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_type AS symbol, event_id, value * 2 AS ratio, 'b' AS source FROM events WHERE event_id % 3 <> 1)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.event_id, b.event_id) AS event_id, interest, coalesce(a.source, b.source) AS source, ratio FROM a FULL JOIN b ON a.symbol = b.symbol AND a.event_id = b.event_id""",
    "interest ratio",
)
def s_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer merge of two metric tables, which overlap and together have all events; the first source named."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "event_id", "value")
    a = e.where("event_id % 3 <> 0").select("symbol", "event_id", F.col("value").alias("interest"), F.lit("a").alias("source"))
    b = e.where("event_id % 3 <> 1").select("symbol", "event_id", (F.col("value") * 2).alias("ratio"), F.lit("b").alias("source"))
    return S.merged(a, b, ["symbol", "event_id"], ["source"])


@query(
    "s_mask_and_field_report",
    """WITH e AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN -value ELSE value END AS interest, CASE WHEN event_id % 3 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS ratio FROM events)
SELECT 'interest' AS field, count(*) AS rows, count(*) FILTER (interest IS NULL) AS missing, count(*) FILTER (interest < 0) AS invalid, count(*) FILTER (interest >= 0) AS valid FROM e
UNION ALL SELECT 'ratio', count(*), 0, count(*) FILTER (isinf(ratio)), count(*) FILTER (NOT isinf(ratio)) FROM e""",
)
def s_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, missing, invalid and valid per metric field."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.when(i % 7 == 0, None).when(i % 5 == 0, -F.col("value")).otherwise(F.col("value")).alias("interest"), F.when(i % 3 == 0, float("inf")).otherwise(F.col("value")).alias("ratio"))
    return S.field_report(e, ["interest", "ratio"])


@query(
    "s_metric_views",
    """SELECT event_type AS symbol, event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS open_interest, 'five_minutes' AS period FROM events WHERE event_id % 5 <> 0 AND value >= 0""",
    "open_interest",
)
def s_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows with the needed value, invalid ones masked, renamed and tagged."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("sum_open_interest"))
    return S.mask_invalid(e, ["sum_open_interest"]).withColumnsRenamed({"sum_open_interest": "open_interest"}).dropna("any", subset=["open_interest"]).withColumn("period", F.lit("five_minutes"))


@query("s_coverage", f'WITH {EV_BARS} SELECT symbol, count(*) AS rows, min(ts) AS "first", max(ts) AS "last" FROM ev_bars GROUP BY symbol')
def s_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact rows and range per symbol."""
    return S.coverage(ev_bars(spark, sf_dir), ["symbol"])


@query(
    "s_manifest_coverage",
    """WITH m AS (SELECT event_type AS symbol, date_trunc('month', ts) AS month, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL),
f AS (SELECT symbol, CAST(month AS DATE) AS lo, last_day(month) AS hi, sum(n) AS n FROM m WHERE symbol IN ('click', 'view') GROUP BY ALL UNION ALL SELECT symbol, CAST(day AS DATE), CAST(day AS DATE), sum(n) FROM m WHERE symbol NOT IN ('click', 'view') GROUP BY ALL)
SELECT symbol, CAST(sum(n) AS BIGINT) AS rows, min(lo) AS "first", max(hi) AS "last" FROM f GROUP BY symbol""",
)
def s_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage from file keys of months and days with row counts."""
    e = table(spark, sf_dir, "events")
    period = F.when(F.col("event_type").isin("click", "view"), F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return S.manifest_coverage(e.groupBy(F.concat_ws("/", F.col("event_type"), F.lit("1h"), F.concat(F.col("event_type"), F.lit("-1h-"), period, F.lit(".zip"))).alias("file_key")).agg(F.count("*").alias("row_count")))


@query(
    "s_conditional_coverage",
    """SELECT event_type AS symbol, count(*) FILTER (value > 20 AND event_id % 2 = 0) AS interest_rows, min(CASE WHEN value > 20 AND event_id % 2 = 0 THEN ts END) AS interest_first, max(CASE WHEN value > 20 AND event_id % 2 = 0 THEN ts END) AS interest_last, count(*) FILTER (event_id % 4 = 0) AS ratio_rows FROM events GROUP BY 1""",
)
def s_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of rows in which all of a group's values are present."""
    both = (F.col("value") > 20) & (F.col("event_id") % 2 == 0)
    found = C.conditional_coverage(table(spark, sf_dir, "events"), [F.col("event_type").alias("symbol")], {"interest": both, "ratio": F.col("event_id") % 4 == 0})
    return found.drop("ratio_first", "ratio_last")


@query(
    "s_catalog",
    f"""WITH {EV_BARS} SELECT 'bars' AS dataset, count(DISTINCT symbol) AS symbols, count(*) AS rows, min(ts) AS "first", max(ts) AS "last" FROM ev_bars
UNION ALL SELECT 'events', count(DISTINCT user_id), count(*), min(ts), max(ts) FROM (SELECT user_id, events.ts AS ts FROM events)""",
)
def s_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, rows and range per dataset."""
    return S.catalog({"bars": ev_bars(spark, sf_dir), "events": table(spark, sf_dir, "events").withColumnRenamed("user_id", "symbol")})


@query(
    "s_upsert",
    """SELECT o_custkey, CAST(max(o_orderkey) AS BIGINT) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey""",
    "o_totalprice",
)
def s_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last load of each key wins."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return S.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query(
    "s_bar_quarantine",
    f"""WITH {EV_BARS}, b AS (SELECT symbol, epoch_ms(ts) + CASE WHEN trades % 7 = 0 THEN 60000 ELSE 0 END AS open_time, epoch_ms(ts) + 3599999 + CASE WHEN trades % 5 = 0 THEN 9000 ELSE 0 END AS close_time, open, CASE WHEN trades = 3 THEN low ELSE high END AS high, low, close, volume, trades, CASE WHEN trades = 4 THEN volume * 2 ELSE volume / 2 END AS taker_volume FROM ev_bars)
, r AS (SELECT symbol, open_time, open_time % 3600000 <> 0 AS unaligned, close_time - open_time - 3599999 > 5000 AS extended, close_time - open_time - 3599999 > 0 AND close_time >= lead(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS next_overlap,
  least(open, high, low, close) <= 0 AS nonpositive, high < greatest(open, close) OR low > least(open, close) AS bounds, taker_volume > volume * (1 + 1e-12) AS taker, volume <= 0 AND trades > 0 AS zero FROM b)
SELECT symbol, open_time, concat_ws(',', CASE WHEN unaligned THEN 'unaligned_open' END, CASE WHEN extended THEN 'extended_close' END, CASE WHEN next_overlap THEN 'overlaps_next' END, CASE WHEN nonpositive THEN 'nonpositive_price' END, CASE WHEN zero THEN 'inconsistent_zero_volume' END, CASE WHEN bounds THEN 'high_low_bounds' END, CASE WHEN taker THEN 'taker_above_total' END) AS reasons FROM r""",
)
def s_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check that a bar fails; some bars are spoilt on purpose."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    n = F.col("trades")
    b = ev_bars(spark, sf_dir).select(
        "symbol", (millis + F.when(n % 7 == 0, 60_000).otherwise(0)).alias("open_time"), (millis + 3_599_999 + F.when(n % 5 == 0, 9000).otherwise(0)).alias("close_time"), "open",
        F.when(n == 3, F.col("low")).otherwise(F.col("high")).alias("high"), "low", "close", "volume", "trades", F.when(n == 4, F.col("volume") * 2).otherwise(F.col("volume") / 2).alias("taker_volume"),
    )
    return S.quarantine(b).select("symbol", "open_time", F.concat_ws(",", "reasons").alias("reasons"))


@query(
    "s_bar_quality",
    f"""WITH {EV_BARS}, g AS (SELECT *, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 3600 AS gap FROM ev_bars)
SELECT symbol, count(*) AS bars, count(*) - count(DISTINCT ts) AS duplicates, CAST((epoch(max(ts)) - epoch(min(ts))) / 3600 AS BIGINT) + 1 - count(DISTINCT ts) AS missing, count(*) FILTER (gap > 1) AS gaps,
  CAST(coalesce(max(CASE WHEN gap > 1 THEN gap - 1 END), 0) AS BIGINT) AS largest_gap, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS out_of_bounds FROM g GROUP BY symbol""",
)
def s_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing bars, gaps, duplicates and bounds per symbol."""
    return S.quality(ev_bars(spark, sf_dir))


_CLOSES = "CASE WHEN trades % 3 = 0 THEN -60000 WHEN trades % 5 = 0 THEN 1000 ELSE 0 END"


@query(
    "s_close_quality",
    f"""WITH {EV_BARS}, b AS (SELECT symbol, high, low, {_CLOSES} AS over_, volume * CASE WHEN trades = 4 THEN 2 ELSE 1 END / trades AS price FROM ev_bars)
SELECT symbol, count(*) AS bars, count(*) FILTER (over_ < 0) AS short_closes, count(*) FILTER (over_ > 0) AS extended_closes, count(*) FILTER (price < low * (1 - 1e-8::DOUBLE) OR price > high * (1 + 1e-8::DOUBLE)) AS taker_outside, count(price) AS taker_priced FROM b GROUP BY symbol""",
)
def s_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short and extended closes, and takers' prices outside the bar; some bars are spoilt on purpose."""
    opened = F.unix_millis(F.col("ts").cast("timestamp"))
    b = ev_bars(spark, sf_dir).select("symbol", "high", "low", opened.alias("open_time"), (opened + 3_599_999 + F.expr(_CLOSES)).alias("close_time"), F.col("trades").alias("taker_base"), (F.col("volume") * F.when(F.col("trades") == 4, 2).otherwise(1)).alias("taker_quote"))
    return S.close_quality(b)


@query(
    "s_windowed_csv",
    f"""WITH {EV_BARS}, g AS (SELECT t.ts, s.symbol FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-19 23:00:00', INTERVAL 1 HOUR)) AS ts) t, (SELECT unnest(['click', 'view']) AS symbol) s)
SELECT g.symbol, g.ts, close, b.ts IS NOT NULL AS present FROM g LEFT JOIN ev_bars b ON b.symbol = g.symbol AND b.ts = g.ts""",
    "close",
)
def s_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as CSV and read back within a window and for two symbols, against the exact grid."""
    folder = S.shared_folder(spark, "bars")
    S.write_report(ev_bars(spark, sf_dir).select("symbol", "ts", "close"), folder)
    start, stop, symbols = "2024-01-10 00:00:00", "2024-01-20 00:00:00", ["click", "view"]
    rows = S.windowed_csv(spark, folder, "symbol string, ts timestamp_ntz, close double", start, stop, symbols)
    hours = f"explode(sequence(TIMESTAMP_NTZ '{start}', TIMESTAMP_NTZ '{stop}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts"
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, symbols))).alias("symbol")).selectExpr("symbol", hours)
    return grid.join(rows.withColumn("present", F.lit(True)), ["symbol", "ts"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


@query("s_stage_window", f"WITH {EV_BARS} SELECT symbol, ts, close FROM ev_bars WHERE ts >= TIMESTAMP '2024-01-10' - INTERVAL 48 HOUR AND ts < TIMESTAMP '2024-01-20'", "close")
def s_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a stage and its warm-up; the reserved stage is refused."""
    return ev_bars(spark, sf_dir).where(S.stage_window("A", {"A": ("2024-01-10 00:00:00", "2024-01-20 00:00:00"), "B": ("2024-01-20 00:00:00", "2024-01-28 00:00:00")}, 48)).select("symbol", "ts", "close")


@query(
    "s_alias_resolution",
    f"WITH {EV_BARS} SELECT symbol, ts, CASE symbol WHEN 'view' THEN '1000view' ELSE symbol END AS market, CASE symbol WHEN 'view' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS multiplier, close / CASE symbol WHEN 'view' THEN 1000 ELSE 1 END AS close, volume * CASE symbol WHEN 'view' THEN 1000 ELSE 1 END AS volume FROM ev_bars",
    "close volume multiplier",
)
def s_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market symbols and contract multipliers from a small alias table."""
    aliases = spark.sql("SELECT 'view' AS alias, '1000view' AS market, 1000.0D AS multiplier")
    named = S.resolve(ev_bars(spark, sf_dir), aliases)
    return P.rescale(named.drop("multiplier"), aliases.select(F.col("alias").alias("symbol"), "multiplier"), ["close"], ["volume"]).select("symbol", "ts", "market", "close", "volume").join(aliases.select(F.col("alias").alias("symbol"), "multiplier"), "symbol", "left").withColumn("multiplier", F.coalesce("multiplier", F.lit(1.0)))


@query("s_tail_snapshot", f"WITH {EV_BARS} SELECT symbol, ts, close, volume FROM ev_bars ORDER BY ts DESC, symbol DESC LIMIT 50", "close volume")
def s_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 bars."""
    return S.tail(ev_bars(spark, sf_dir).select("symbol", "ts", "close", "volume"), 50, ["ts", "symbol"])


@query(
    "s_grid_violations",
    f"""WITH {EV_GRID}, k AS (SELECT symbol, ts + CASE WHEN trades = 6 THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END AS ts FROM ev_grid WHERE trades IS NULL OR trades <> 5),
t AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM k)
SELECT 'off_hour' AS violation, symbol, ts FROM k WHERE date_trunc('hour', ts) <> ts
UNION ALL SELECT 'missing', s.symbol, t.ts FROM (SELECT DISTINCT symbol FROM k) s CROSS JOIN t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.symbol = s.symbol AND k.ts = t.ts)""",
)
def s_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that a dense grid lacks and times off the hour; some rows are spoilt on purpose."""
    g = ev_grid(spark, sf_dir).where("trades is null or trades <> 5")
    return P.violations(g.select("symbol", (F.col("ts") + F.when(F.col("trades") == 6, F.expr("INTERVAL 1 MINUTE")).otherwise(F.expr("INTERVAL 0 MINUTE"))).alias("ts"), F.lit(True).alias("eligible")))


@query(
    "s_append_only",
    """WITH s AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 1)
SELECT b.o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'new' WHEN s.o_totalprice = b.o_totalprice THEN 'same' ELSE 'conflict' END AS outcome FROM b LEFT JOIN s USING (o_orderkey)""",
)
def s_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch against an append-only store: new, same or conflict per key."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    batch = o.where("o_orderkey % 3 <> 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return S.append_only(o.where("o_orderkey % 3 <> 0"), batch, ["o_orderkey"], ["o_totalprice"]).select("o_orderkey", "outcome")


@query("s_paged_values", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100 OFFSET 200", "o_totalprice")
def s_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of ordered values with the total, found by counts of ranges."""
    return A.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 200, 100, most=1 << 10)


@query(
    "s_universe_counts",
    f"WITH {USER_UNIVERSE} SELECT symbol, count(*) AS rows, count(*) FILTER (eligible) AS eligible FROM us_uni GROUP BY symbol",
)
def s_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and eligible rows of a universe with false members."""
    return user_universe(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if("eligible").alias("eligible"))
