"""Archives beside their manifest, partitioned upserts, the universe file, and faults of structure (S, P, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import liquidations as L
from panelwright.operators import panel as P
from panelwright.plans.base import EV_BARS, NATION_WEEK, USER_UNIVERSE, ev_bars, nation_week, query, table, user_universe
from panelwright.plans.liquidation import _ALIGNED, _aligned
from panelwright.sources import archives as A
from panelwright.sources import tables as S


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")


@query(
    "s_manifest_or_scan",
    """SELECT event_type AS symbol, count(*) AS rows, CASE WHEN event_type IN ('click', 'view') THEN CAST(date_trunc('month', min(ts)) AS DATE) ELSE CAST(min(ts) AS DATE) END AS "first", CASE WHEN event_type IN ('click', 'view') THEN last_day(max(ts)) ELSE CAST(max(ts) AS DATE) END AS "last",
  CASE WHEN event_type IN ('click', 'view') THEN 'manifest' ELSE 'scan' END AS source FROM (SELECT event_type, events.ts AS ts FROM events) GROUP BY event_type""",
)
def s_manifest_or_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage from the manifest for symbols that it has, and from the partitions of all other symbols, which alone are read."""
    e = _events(spark, sf_dir)
    folder = S.shared_folder(spark, "archive")
    A.write_partitioned(e, folder, "symbol")
    files = e.where("symbol in ('click', 'view')").groupBy(F.concat_ws("/", "symbol", F.lit("1h"), F.concat("symbol", F.lit("-1h-"), F.date_format("ts", "yyyy-MM"), F.lit(".zip"))).alias("file_key")).agg(F.count("*").alias("row_count"))
    archive = spark.read.parquet(folder)
    return A.coverage_or_scan(archive.select("symbol").distinct(), S.manifest_coverage(files), archive)


@query(
    "s_funding_sources",
    """WITH e AS (SELECT event_type AS symbol, events.ts AS ts, event_id, value AS rate, CASE WHEN event_id % 3 <> 0 THEN value * 2 END AS mark, 'd' || CAST(day(events.ts) // 10 AS VARCHAR) AS part FROM events),
n AS (SELECT symbol, ts, event_id, rate, coalesce(CASE WHEN event_id % 5 = 0 THEN value_mark END, mark) AS mark_price, part, 'new' AS origin FROM (SELECT *, mark + 1 AS value_mark FROM e) WHERE symbol IN ('click', 'error') AND event_id % 2 = 0),
l AS (SELECT symbol, ts, event_id, rate, mark AS mark_price, part, 'legacy' AS origin FROM e WHERE symbol NOT IN (SELECT symbol FROM n))
SELECT symbol, ts, event_id, rate, mark_price, origin, CASE WHEN part <> 'd1' THEN origin || '/' || symbol || '-' || part || '.zip' END AS source_path FROM (SELECT * FROM n UNION ALL SELECT * FROM l)""",
    "rate mark_price",
)
def s_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new table's events for symbols that it has, the legacy table's for others; marks filled from the legacy table; each row's archive from the manifest, by its file's place."""
    e = _events(spark, sf_dir).withColumnRenamed("value", "rate").withColumns({"mark_price": F.when(F.col("event_id") % 3 != 0, F.col("rate") * 2), "part": F.concat(F.lit("d"), F.floor(F.dayofmonth("ts") / 10))})
    new = e.where("symbol in ('click', 'error') and event_id % 2 = 0").withColumn("mark_price", F.when(F.col("event_id") % 5 == 0, F.col("mark_price") + 1))
    read = {}
    for origin, rows in (("new", new), ("legacy", e)):
        folder = S.shared_folder(spark, origin)
        rows.write.partitionBy("symbol", "part").parquet(folder)
        keys = rows.where("part <> 'd1'").select("symbol", "part").distinct()
        manifest = keys.select(F.format_string("symbol=%s/part=%s", "symbol", "part").alias("file_key"), F.format_string(f"{origin}/%s-%s.zip", "symbol", "part").alias("source_path"))
        read[origin] = A.with_source_path(spark, folder, manifest, 2).drop("part", "file_key")
    marks = read["legacy"].select("symbol", "event_id", "mark_price")
    return A.funding(read["new"], read["legacy"], marks, ["symbol", "event_id"]).select("symbol", "ts", "event_id", "rate", "mark_price", "origin", "source_path")


@query(
    "s_consolidated_coverage",
    """WITH e AS (SELECT event_type AS symbol, events.ts AS ts, event_id FROM events), c AS (SELECT * FROM e WHERE symbol IN ('click', 'error') AND event_id % 2 = 0)
SELECT symbol, count(*) AS rows, min(ts) AS "first", max(ts) AS "last", 'consolidated' AS source FROM c GROUP BY symbol UNION ALL SELECT symbol, count(*), min(ts), max(ts), 'legacy' FROM e WHERE symbol NOT IN (SELECT symbol FROM c) GROUP BY symbol""",
)
def s_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage from consolidated rows where a symbol has any, else from the legacy table."""
    e = _events(spark, sf_dir)
    return A.consolidated_coverage(e.where("symbol in ('click', 'error') and event_id % 2 = 0"), e)


_CATALOG = f"""{EV_BARS}, b4 AS (SELECT symbol, to_timestamp(floor(epoch(ts) / 14400) * 14400)::TIMESTAMP AS ts FROM ev_bars GROUP BY 1, 2 HAVING count(*) = 4),
ca AS (SELECT 'bars' AS dataset, '1h' AS "interval", symbol, ts FROM ev_bars UNION ALL SELECT 'bars', '4h', symbol, ts FROM b4 UNION ALL SELECT 'events', NULL, event_type, e.ts FROM events e)"""


def _catalogued(spark: SparkSession, sf_dir: str) -> list[tuple[str, str | None, DataFrame]]:
    bars = ev_bars(spark, sf_dir)
    return [("bars", "1h", bars), ("bars", "4h", P.coarser(bars, 4)), ("events", None, _events(spark, sf_dir))]


@query("s_catalog_by_interval", f'WITH {_CATALOG} SELECT dataset, "interval", count(DISTINCT symbol) AS symbols, count(*) AS rows, min(ts) AS "first", max(ts) AS "last" FROM ca GROUP BY 1, 2')
def s_catalog_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, rows and range per dataset and interval."""
    return A.catalog(_catalogued(spark, sf_dir))


@query("s_catalog_by_symbol", f'WITH {_CATALOG} SELECT dataset, "interval", symbol, count(*) AS rows, min(ts) AS "first", max(ts) AS "last" FROM ca GROUP BY 1, 2, 3')
def s_catalog_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and range per dataset, interval and symbol."""
    return A.catalog(_catalogued(spark, sf_dir), per_symbol=True)


@query(
    "s_partition_upsert",
    f"""WITH {EV_BARS} SELECT symbol, ts, CASE WHEN symbol IN ('click', 'view') AND trades % 2 = 0 THEN close * 2 ELSE close END AS close, CASE WHEN symbol IN ('click', 'view') AND trades % 2 = 0 THEN 1 ELSE 0 END AS load FROM ev_bars
UNION ALL SELECT 'new', ts, close, 1 FROM ev_bars WHERE symbol = 'view'""",
    "close",
)
def s_partition_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a folder a symbol takes a load for some of them and a new one; other folders aren't touched."""
    bars = ev_bars(spark, sf_dir).select("symbol", "ts", "close", "trades")
    folder = S.shared_folder(spark, "upsert")
    A.write_partitioned(bars.select("symbol", "ts", "close", F.lit(0).alias("load")), folder, "symbol")
    again = bars.where("symbol in ('click', 'view') and trades % 2 = 0").select("symbol", "ts", (F.col("close") * 2).alias("close"), F.lit(1).alias("load"))
    fresh = bars.where("symbol = 'view'").select(F.lit("new").alias("symbol"), "ts", "close", F.lit(1).alias("load"))
    A.upsert_partitions(spark, folder, again.unionByName(fresh), ["symbol", "ts"], "load")
    return spark.read.parquet(folder).select("symbol", "ts", "close", "load")


_SPOILT = """u AS (SELECT symbol, ts, eligible, CAST(epoch(ts) AS BIGINT) // 3600 + CAST(substr(symbol, 2) AS BIGINT) AS n FROM us_uni),
sl AS (SELECT *, n % 20 AS k, CASE WHEN eligible THEN CASE WHEN n % 3 = 0 THEN 'true' ELSE '1' END ELSE CASE WHEN n % 3 = 0 THEN 'False' ELSE '0' END END AS tok, strftime(ts, '%Y-%m-%dT%H') AS z FROM u),
li AS (SELECT *, CASE k WHEN 1 THEN z || ':00:00Z,' || symbol || ',yes' WHEN 2 THEN z || ':00:00,' || symbol || ',' || tok WHEN 3 THEN z || ':00:00Z,' || symbol || ',' || tok || ',x' WHEN 4 THEN z || ':00:00Z,' || symbol
    WHEN 5 THEN z || ':30:00Z,' || symbol || ',' || tok WHEN 6 THEN z || ':77:00Z,' || symbol || ',' || tok WHEN 7 THEN z || ':00:00Z,,' || tok ELSE z || ':00:00Z,' || symbol || ',' || tok END AS line,
  CASE k WHEN 1 THEN 'bad_token' WHEN 2 THEN 'no_zone' WHEN 3 THEN 'malformed_line' WHEN 4 THEN 'malformed_line' WHEN 5 THEN 'off_hour' WHEN 6 THEN 'bad_time' WHEN 7 THEN 'no_symbol' WHEN 8 THEN 'repeated_key' END AS reason FROM sl)"""


@query(
    "s_universe_file",
    f"""WITH {USER_UNIVERSE}, {_SPOILT} SELECT 'member' AS kind, symbol || ' ' || CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR) || ' ' || CAST(eligible AS VARCHAR) AS line FROM li WHERE reason IS NULL AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-25'
UNION ALL SELECT reason, line FROM li, (SELECT unnest([1, 2]) AS twice) WHERE reason IS NOT NULL AND (twice = 1 OR reason = 'repeated_key')""",
)
def s_universe_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A universe file with spoilt tokens, zones, times and lines, written and read back: members of the stage and its warm-up, and every line in quarantine with its reason."""
    u = user_universe(spark, sf_dir).select("symbol", "ts", "eligible", F.expr("unix_seconds(cast(ts as timestamp)) div 3600 + cast(substr(symbol, 2) as bigint)").alias("n"))
    token = F.when(F.col("eligible"), F.when(F.col("n") % 3 == 0, "true").otherwise("1")).otherwise(F.when(F.col("n") % 3 == 0, "False").otherwise("0"))
    z = F.date_format("ts", "yyyy-MM-dd'T'HH")
    line = lambda minute, *rest: F.concat(z, F.lit(minute), *[x for r in rest for x in (F.lit(","), r)])
    k, s = F.col("n") % 20, F.col("symbol")
    spoilt = {1: line(":00:00Z", s, F.lit("yes")), 2: line(":00:00", s, token), 3: line(":00:00Z", s, token, F.lit("x")), 4: line(":00:00Z", s), 5: line(":30:00Z", s, token), 6: line(":77:00Z", s, token), 7: line(":00:00Z", F.lit(""), token)}
    made = line(":00:00Z", s, token)
    for case, text in spoilt.items():
        made = F.when(k == case, text).otherwise(made)
    folder = S.shared_folder(spark, "universe")
    u.select(F.explode(F.array_repeat(made, F.when(k == 8, 2).otherwise(1))).alias("value")).write.text(folder)
    good, bad = A.membership(spark, folder, "2024-01-03 00:00:00", "2024-01-25 00:00:00", 24, header=False)
    return good.select(F.lit("member").alias("kind"), F.concat_ws(" ", "symbol", F.unix_seconds("timestamp").cast("string"), F.col("eligible").cast("string")).alias("line")).unionByName(bad.select(F.col("reason").alias("kind"), "line"))


_TWICE = f"""{USER_UNIVERSE}, gr AS (SELECT symbol, ts, CASE WHEN trades = 2 THEN NULL WHEN symbol = 'u5' THEN false ELSE eligible END AS eligible FROM us_uni WHERE NOT (symbol = 'u3' AND hour(ts) = 4)
  UNION ALL SELECT '1000u1', ts, eligible FROM us_uni WHERE symbol = 'u1' AND hour(ts) = 7 UNION ALL SELECT symbol, ts, eligible FROM us_uni WHERE symbol = 'u2' AND hour(ts) = 9 UNION ALL SELECT symbol, ts + INTERVAL 10 MINUTE, eligible FROM us_uni WHERE symbol = 'u4' AND hour(ts) = 11)"""


@query(
    "s_universe_faults",
    f"""WITH {_TWICE}, ce AS (SELECT CASE symbol WHEN '1000u1' THEN 'u1' ELSE symbol END AS market, ts, symbol, count(*) AS n, count(*) FILTER (eligible IS NULL) AS unknown, bool_or(eligible) AS yes FROM gr GROUP BY 1, 2, 3),
ke AS (SELECT market, ts, count(*) AS names, max(n) AS most, CAST(sum(n) AS BIGINT) AS n, sum(unknown) AS unknown, bool_or(yes) AS yes FROM ce GROUP BY 1, 2), ti AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), max(ts), INTERVAL 1 HOUR)) AS ts FROM ke)
SELECT 'alias_duplicate' AS violation, market AS symbol, ts, n AS rows FROM ke WHERE names > 1 UNION ALL SELECT 'repeated', market, ts, n FROM ke WHERE most > 1 UNION ALL SELECT 'off_hour', market, ts, n FROM ke WHERE date_trunc('hour', ts) <> ts UNION ALL SELECT 'unknown_membership', market, ts, n FROM ke WHERE unknown > 0
UNION ALL SELECT 'missing', m.market, ti.ts, 0 FROM (SELECT DISTINCT market FROM ke) m CROSS JOIN ti ANTI JOIN ke ON ke.market = m.market AND ke.ts = ti.ts UNION ALL SELECT 'never_eligible', market, min(ts), CAST(sum(n) AS BIGINT) FROM ke GROUP BY market HAVING NOT coalesce(bool_or(yes), false)""",
)
def s_universe_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two names of one market, repeated rows, null membership, times off the hour, missing cells and a symbol that is never a member, all planted."""
    u = user_universe(spark, sf_dir).select("symbol", "ts", "eligible", "trades")
    base = u.where(~((F.col("symbol") == "u3") & (F.hour("ts") == 4))).select("symbol", "ts", F.when(F.coalesce(F.col("trades") == 2, F.lit(False)), None).when(F.col("symbol") == "u5", False).otherwise(F.col("eligible")).alias("eligible"))
    of = lambda symbol, hour: u.where((F.col("symbol") == symbol) & (F.hour("ts") == hour)).select("symbol", "ts", "eligible")
    grid = base.unionByName(of("u1", 7).withColumn("symbol", F.lit("1000u1"))).unionByName(of("u2", 9)).unionByName(of("u4", 11).withColumn("ts", F.expr("ts + INTERVAL 10 MINUTE")))
    return A.universe_faults(grid, spark.sql("SELECT '1000u1' AS alias, 'u1' AS market"))


@query(
    "s_positioning_view",
    """WITH m AS (SELECT event_type AS symbol, events.ts AS ts, event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS oi, CASE WHEN event_id % 4 <> 1 THEN value * 3 END AS oiv, CASE WHEN event_id % 3 <> 0 THEN value / 2 END AS r1, CASE WHEN event_id % 7 <> 0 THEN value / 3 ELSE -1 END AS r2, value / 4 AS r3, CASE WHEN event_id % 11 <> 0 THEN value / 5 END AS r4 FROM events)
SELECT 'open_interest' AS view, symbol, ts, event_id, '5m' AS period, oi AS a, oiv AS b FROM m WHERE oi >= 0 AND oiv >= 0 UNION ALL SELECT 'positioning', symbol, ts, event_id, '5m', r1, r2 FROM m WHERE r1 >= 0 AND r2 >= 0 AND r3 >= 0 AND r4 >= 0""",
    "a b",
)
def s_positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open-interest view, which needs both values, and the positioning view, which needs all four ratios; invalid ones are masked first."""
    i, v = F.col("event_id"), F.col("value")
    fields = {"oi": F.when(i % 5 != 0, v), "oiv": F.when(i % 4 != 1, v * 3), "r1": F.when(i % 3 != 0, v / 2), "r2": F.when(i % 7 != 0, v / 3).otherwise(-1.0), "r3": v / 4, "r4": F.when(i % 11 != 0, v / 5)}
    masked = S.mask_invalid(_events(spark, sf_dir).withColumns(fields), [*fields])
    seen = lambda name, needed: A.complete_views(masked, needed, "5m").select(F.lit(name).alias("view"), "symbol", "ts", "event_id", "period", F.col(needed[0]).alias("a"), F.col(needed[1]).alias("b"))
    return seen("open_interest", ["oi", "oiv"]).unionByName(seen("positioning", ["r1", "r2", "r3", "r4"]))


@query("p_repeated_times", "SELECT event_type AS symbol, date_trunc('minute', events.ts) AS ts, count(*) AS rows FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def p_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: events of one symbol that share their time, to the minute; funding needs none."""
    return A.unique_times(_events(spark, sf_dir).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz")), ["symbol", "ts"])


@query(
    "p_coverage_rollup",
    f"""WITH {NATION_WEEK}, pm AS (SELECT r_name AS market, nw.symbol, eligible, momentum, CASE WHEN n_regionkey < 3 THEN CAST(trades AS DOUBLE) END AS activity, CAST(NULL AS DOUBLE) AS nothing FROM nw JOIN nation ON nw.symbol = 'n' || CAST(n_nationkey AS VARCHAR) JOIN region ON n_regionkey = r_regionkey),
lo AS (SELECT market, symbol, eligible, 'momentum' AS field, momentum AS v FROM pm UNION ALL SELECT market, symbol, eligible, 'activity', activity FROM pm UNION ALL SELECT market, symbol, eligible, 'nothing', nothing FROM pm),
ro AS (SELECT market, field, symbol, CAST(GROUPING(market, field, symbol) AS INTEGER) AS level, count(*) AS rows, count(*) FILTER (eligible) AS eligible, count(*) FILTER (eligible AND v IS NOT NULL) AS valid FROM lo GROUP BY ROLLUP (market, field, symbol)),
rq(field, needed) AS (VALUES ('momentum', 300), ('activity', 100)), fl AS (SELECT market, field, valid FROM ro WHERE level = 1),
li AS (SELECT market, 3 AS level, coalesce(string_agg(field, ',' ORDER BY field) FILTER (valid > 0), '') AS covered, coalesce(string_agg(field, ',' ORDER BY field) FILTER (valid = 0), '') AS uncovered FROM fl GROUP BY market
  UNION ALL SELECT NULL, 7, coalesce(string_agg(field, ',' ORDER BY field) FILTER (v > 0), ''), coalesce(string_agg(field, ',' ORDER BY field) FILTER (v = 0), '') FROM (SELECT field, sum(valid) AS v FROM fl GROUP BY field))
SELECT ro.level, ro.market, ro.field, ro.symbol, rows, eligible, valid, needed, valid >= needed AS ready, covered, uncovered FROM ro LEFT JOIN rq ON rq.field = ro.field LEFT JOIN li ON li.level = ro.level AND li.market IS NOT DISTINCT FROM ro.market""",
)
def p_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage per region, field and nation with its rollups, readiness against required counts, and the lists of covered and uncovered fields."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("symbol"), F.col("r_name").alias("market"), "n_regionkey")
    panel = nation_week(spark, sf_dir).join(nations, "symbol").select("market", "symbol", "eligible", "momentum", F.when(F.col("n_regionkey") < 3, F.col("trades").cast("double")).alias("activity"), F.lit(None).cast("double").alias("nothing"))
    required = spark.sql("SELECT * FROM VALUES ('momentum', 300), ('activity', 100) AS t(field, needed)")
    return P.coverage_rollup(panel, ["momentum", "activity", "nothing"], required)


@query(
    "l_structure_faults",
    f"""WITH {_ALIGNED}, sp AS (SELECT al.*, symbol AS file_symbol, ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS close_ts, available_at AS received FROM al), h AS (SELECT *, (CAST(epoch(ts) AS BIGINT) // 3600 + CAST(substr(symbol, 2) AS BIGINT)) % 23 AS k FROM sp),
x AS (SELECT symbol, ts, k, CASE k WHEN 1 THEN 'u99' ELSE file_symbol END AS file_symbol, CASE k WHEN 2 THEN 'valid' ELSE status END AS status, CASE k WHEN 3 THEN close_ts + INTERVAL 1 MINUTE ELSE close_ts END AS close_ts, CASE k WHEN 4 THEN available_at + INTERVAL 1 SECOND ELSE received END AS received, available_at, CASE WHEN k = 5 THEN 1 ELSE events END AS events, long_events, short_events, long_notional, short_notional FROM h),
y AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE k = 6)
SELECT 'symbol_mismatch' AS fault, symbol, ts FROM y WHERE k = 1 UNION ALL SELECT 'unknown_status', symbol, ts FROM y WHERE k = 2 UNION ALL SELECT 'wrong_close', symbol, ts FROM y WHERE k = 3 UNION ALL SELECT 'received_after_available', symbol, ts FROM y WHERE k = 4
UNION ALL SELECT 'nonzero_valid_zero', symbol, ts FROM y WHERE status = 'valid_zero' AND (events <> 0 OR long_events <> 0 OR short_events <> 0 OR long_notional <> 0 OR short_notional <> 0) UNION ALL SELECT 'repeated_key', symbol, ts FROM y GROUP BY symbol, ts HAVING count(*) > 1""",
)
def l_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned rows that a reader must refuse; one fault of each kind is planted in every 23rd row."""
    al = _aligned(spark, sf_dir).withColumns({"file_symbol": F.col("symbol"), "close_ts": F.expr("ts + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND"), "received": F.col("available_at"), "k": F.expr("(unix_seconds(cast(ts as timestamp)) div 3600 + cast(substr(symbol, 2) as bigint)) % 23")})
    k = F.col("k")
    spoilt = al.withColumns({
        "file_symbol": F.when(k == 1, "u99").otherwise(F.col("file_symbol")), "status": F.when(k == 2, "valid").otherwise(F.col("status")), "close_ts": F.when(k == 3, F.expr("close_ts + INTERVAL 1 MINUTE")).otherwise(F.col("close_ts")),
        "received": F.when(k == 4, F.expr("available_at + INTERVAL 1 SECOND")).otherwise(F.col("received")), "events": F.when(k == 5, 1).otherwise(F.col("events")),
    })
    return L.structure_faults(spoilt.unionByName(spoilt.where("k = 6")))
