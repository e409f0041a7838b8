"""Comparisons, search and digests (V), and the streaming jobs (ST) over their batch rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import comparison as V
from panelwright.operators import displacement as R
from panelwright.operators import evaluate as E
from panelwright.plans.base import EV_BARS, NATION_WEEK, USER_UNIVERSE, ev_bars, nation_week, query, table, user_universe, wilder_sql
from panelwright.streaming import jobs as ST


@query(
    "v_field_comparison",
    f"""WITH {EV_BARS}, b AS (SELECT symbol, ts, CASE WHEN trades % 3 = 0 THEN close + 0.25 ELSE close END AS close, CASE WHEN trades = 5 THEN NULL ELSE volume END AS volume FROM ev_bars), j AS (SELECT 'close' AS field, a.close AS x, b.close AS y FROM ev_bars a JOIN b ON a.symbol = b.symbol AND a.ts = b.ts UNION ALL SELECT 'volume', a.volume, b.volume FROM ev_bars a JOIN b ON a.symbol = b.symbol AND a.ts = b.ts)
SELECT field, count(*) AS cells, count(x) AS finite_a, count(y) AS finite_b, count(*) FILTER (x = y) AS equal, count(*) FILTER (x <> y AND abs(x - y) <= 1e-15 + 1e-12 * abs(y)) AS within, count(*) FILTER (abs(x - y) > 1e-15 + 1e-12 * abs(y)) AS beyond, max(abs(x - y)) AS max_abs, max(abs(x - y) / nullif(abs(y), 0)) AS max_rel FROM j GROUP BY field""",
    "max_abs max_rel",
)
def v_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: two panels field by field; one is spoilt on purpose."""
    a = ev_bars(spark, sf_dir)
    b = a.select("symbol", "ts", F.when(F.col("trades") % 3 == 0, F.col("close") + 0.25).otherwise(F.col("close")).alias("close"), F.when(F.col("trades") != 5, F.col("volume")).alias("volume"))
    # one aggregation gives both sides the same sums, whatever the order of its rows
    a = a.select("symbol", "ts", "close", F.round("volume", 6).alias("volume"))
    return V.compare_fields(a, b.withColumn("volume", F.round("volume", 6)), ["symbol", "ts"], ["close", "volume"])


@query(
    "v_label_comparison",
    f"""WITH {NATION_WEEK}, l AS (SELECT symbol, ts, CASE WHEN eligible AND lead(open, 1) OVER w > 0 AND lead(open, 2) OVER w > 0 THEN lead(open, 2) OVER w / lead(open, 1) OVER w - 1 END AS x, trades FROM nw WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
b AS (SELECT symbol, ts, x, CASE WHEN trades = 3 THEN NULL WHEN trades = 4 THEN x + 0.5 ELSE x END AS y FROM l), t AS (SELECT ts, count(*) FILTER ((x IS NULL) <> (y IS NULL)) AS mm, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS c, count(*) FILTER (abs(x - y) > 1e-12) AS d FROM b GROUP BY ts)
SELECT 1 AS horizon, CAST(sum(mm) AS BIGINT) AS mismatched, CAST(sum(c) AS BIGINT) AS common, count(*) FILTER (c >= 20) AS full_times, CAST(sum(d) AS BIGINT) AS different FROM t""",
)
def v_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: labels of two sources by horizon; one is spoilt on purpose."""
    a = E.forward_labels(nation_week(spark, sf_dir), [1]).select("horizon", "ts", "symbol", "trades", "forward_return")
    n = F.col("trades")
    b = a.withColumn("forward_return", F.when(n == 3, None).when(n == 4, F.col("forward_return") + 0.5).otherwise(F.col("forward_return")))
    return V.compare_labels(a, b)


@query(
    "v_endpoint_support",
    f"""WITH {NATION_WEEK}, o AS (SELECT symbol, ts FROM nw WHERE eligible AND momentum IS NOT NULL), n AS (SELECT symbol, ts FROM nw WHERE eligible AND reversal IS NOT NULL), d AS (SELECT unnest([1, 4]) AS delta),
po AS (SELECT delta, a.symbol, a.ts FROM o a CROSS JOIN d JOIN o b ON b.symbol = a.symbol AND b.ts = a.ts - delta * INTERVAL 7 DAY), pn AS (SELECT delta, a.symbol, a.ts FROM n a CROSS JOIN d JOIN n b ON b.symbol = a.symbol AND b.ts = a.ts - delta * INTERVAL 7 DAY)
SELECT d.delta, (SELECT count(*) FROM po WHERE po.delta = d.delta) AS old, (SELECT count(*) FROM pn WHERE pn.delta = d.delta) AS new, (SELECT count(*) FROM po JOIN pn USING (delta, symbol, ts) WHERE po.delta = d.delta) AS common FROM d""",
)
def v_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: rows with both endpoints in the old source, the new one and both."""
    nw = nation_week(spark, sf_dir)
    old, new = (R.pairs(nw, f, [1, 4], [], 7 * 86400).select("delta", "symbol", "ts", F.lit(1).alias(n)) for f, n in (("momentum", "o"), ("reversal", "n")))
    both = old.join(new, ["delta", "symbol", "ts"], "full")
    return both.groupBy("delta").agg(F.count("o").alias("old"), F.count("n").alias("new"), F.count(F.col("o") + F.col("n")).alias("common"))


@query("v_input_support", f"WITH {NATION_WEEK}, t AS (SELECT ts, count(*) FILTER (eligible AND momentum IS NOT NULL AND reversal IS NOT NULL AND activity IS NOT NULL) AS n FROM nw GROUP BY ts) SELECT CAST(sum(n) AS BIGINT) AS cells, count(*) FILTER (n >= 20) AS full_times, min(n) AS fewest, max(n) AS most FROM t")
def v_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4-V5: cells in which every input is finite."""
    return V.input_support(nation_week(spark, sf_dir), ["momentum", "reversal", "activity"])


_TWO = f"""{USER_UNIVERSE}, nu AS (SELECT symbol, ts, eligible AND trades % 4 <> 0 OR (NOT eligible AND hour(ts) = 5) AS eligible FROM us_uni), df AS (SELECT o.symbol, o.ts, coalesce(o.eligible, false) AS x, coalesce(n.eligible, false) AS y FROM us_uni o FULL JOIN nu n ON o.symbol = n.symbol AND o.ts = n.ts)"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = user_universe(spark, sf_dir).select("symbol", "ts", "eligible", "trades")
    new = old.withColumn("eligible", (F.col("eligible") & (F.col("trades") % 4 != 0)) | (~F.col("eligible") & (F.hour("ts") == 5)))
    return old.drop("trades"), new.drop("trades")


@query("v_universe_differences", f"WITH {_TWO} SELECT symbol, count(*) FILTER (x) AS only_old, count(*) FILTER (y) AS only_new, min(ts) AS \"first\", max(ts) AS \"last\", CASE WHEN symbol IN ('u1', 'u2') THEN 'declared' END AS ended FROM df WHERE x <> y GROUP BY symbol")
def v_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: differing eligibility per symbol beside its declared end."""
    return V.universe_differences(*_two(spark, sf_dir), spark.sql("SELECT explode(array('u1', 'u2')) AS symbol, 'declared' AS ended"))


@query("v_universe_members", f"WITH {_TWO} SELECT ts, count(*) FILTER (x) AS old, count(*) FILTER (y) AS new, count(*) FILTER (x AND y) AS common FROM df GROUP BY ts")
def v_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: members of the old universe, the new one and both at each time."""
    return V.members(*_two(spark, sf_dir))


@query("v_keyword_search", "WITH s AS (SELECT doc_id, contains(lower(text), 'that')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'que')::INT AS score FROM documents) SELECT doc_id, coalesce(score, 0) AS score, (SELECT count(*) FROM s WHERE score > 0) > 20 AS truncated FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def v_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: the 20 documents that hold most of three terms."""
    return V.search(table(spark, sf_dir, "documents"), ["that", "Und", "que", "und"], "text", "doc_id")


@query(
    "v_table_digest",
    """WITH h AS (SELECT o_orderpriority, CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(o_orderkey AS VARCHAR), '~'), coalesce(CAST(o_custkey AS VARCHAR), '~'), coalesce(o_orderstatus, '~'), coalesce(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '~'))), 1, 15) AS BIGINT) AS h FROM orders)
SELECT o_orderpriority, count(*) AS rows, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM h GROUP BY 1""",
)
def v_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free digests of a table's rows per key."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)"))
    return V.digest(rows, ["o_orderpriority"])


@query("st_hourly_bars", f"WITH {EV_BARS} SELECT symbol, ts, open, high, low, close, volume, trades FROM ev_bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(events.ts) FROM events) - INTERVAL 10 MINUTE", "open high low close volume")
def st_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: hourly bars from a stream; only windows that the watermark has passed come out."""
    return ST.replay(spark, sf_dir, ST.hourly_bars)


@query(
    "st_late_totals",
    """WITH r AS (SELECT event_type AS symbol, date_trunc('hour', events.ts) AS ts, value, events.ts + CAST(json_extract_string(props, '$.k') AS INTEGER) * INTERVAL 1 MINUTE AS received FROM events)
SELECT symbol, ts, count(*) AS events, sum(value) AS notional, count(*) FILTER (received > ts + INTERVAL 1 HOUR) AS late FROM r WHERE ts + INTERVAL 1 HOUR <= (SELECT max(events.ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""",
    "notional",
)
def st_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: hourly totals from a stream, late arrivals counted apart."""
    return ST.replay(spark, sf_dir, ST.late_totals)


@query(
    "st_expiring_join",
    """SELECT a.event_id AS purchase, b.event_id AS view, a.ts AS ts FROM events a JOIN events b ON a.event_type = 'purchase' AND b.event_type = 'view' AND a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 6 HOUR""",
)
def st_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined to all views of the last six hours of the same user."""
    return ST.replay(spark, sf_dir, ST.expiring_join)


@query("st_online_rsi", f"WITH RECURSIVE se AS (SELECT event_type AS symbol, user_id, events.ts AS ts, value FROM events), {wilder_sql('se', 'value', 'symbol, user_id', 14)} SELECT symbol, user_id, ts, rsi FROM wilder", "rsi")
def st_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: Wilder's index of each event type and user, its state kept between batches of a stream."""
    return ST.online_rsi(spark, sf_dir)


@query("st_online_rsi_all", rounded="rsi")
def st_rsi_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: Wilder's index along all events of a type, whoever made them, batch after batch; that recursion is too long for SQL."""
    return ST.replay_rsi(spark, sf_dir)


@query(
    "st_latest_snapshot",
    """WITH a AS (SELECT event_id AS purchase, user_id, events.ts AS ts FROM events WHERE event_type = 'purchase' AND epoch_ms(events.ts) <= (SELECT epoch_ms(max(events.ts)) FROM events) - 600000),
m AS (SELECT user_id, events.ts AS event_ts, CASE WHEN event_id % 7 <> 0 THEN value END AS interest, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS DOUBLE) END AS ratio FROM events WHERE event_type IN ('view', 'click')),
j AS (SELECT a.user_id, a.purchase, a.ts, m.event_ts, m.interest, m.ratio, m.event_ts IS NOT NULL AND a.ts - m.event_ts < INTERVAL 6 HOUR AS fresh FROM a ASOF LEFT JOIN m ON a.user_id = m.user_id AND a.ts >= m.event_ts)
SELECT user_id, purchase, ts, CASE WHEN fresh THEN interest END AS interest, CASE WHEN fresh THEN ratio END AS ratio,
  CASE WHEN NOT fresh THEN 'stale' WHEN interest IS NULL AND ratio IS NULL THEN 'missing' WHEN interest IS NULL OR ratio IS NULL THEN 'partial' ELSE 'valid' END AS status, CASE WHEN fresh THEN (epoch_us(ts) - epoch_us(event_ts)) / 60e6 END AS age_minutes FROM j""",
    "interest ratio age_minutes",
)
def st_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3, P7: every purchase in a stream with its user's latest snapshot, its status and age; state and timers in event time."""

    def job(events: DataFrame) -> DataFrame:
        asks = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), "ts")
        seen = events.where("event_type in ('view', 'click')").select("user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("interest"), F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("double")).alias("ratio"))
        return ST.latest_snapshots(asks, seen, "user_id", "purchase", 360, ["interest", "ratio"])

    return ST.replay(spark, sf_dir, job, store="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
