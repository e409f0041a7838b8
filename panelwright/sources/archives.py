"""Archives of files beside their manifest, partitioned upserts, paging by ranges, and the universe file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.sources.tables import stored, upsert


def coverage_or_scan(symbols: DataFrame, manifest: DataFrame, archive: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows, first and last day per symbol: from the manifest's period coverage where it has the symbol, else from the rows themselves.

    ``symbols`` names all of them, ``manifest`` is ``(symbol, rows, first, last)``, ``archive`` a table
    partitioned by symbol. The symbols that the manifest lacks go to the scan as a broadcast of a
    list of symbols, so that Spark prunes the other symbols' partitions at run time.
    """
    named = symbols.select("symbol").distinct().join(manifest.withColumn("files", F.lit(1)), "symbol", "left")
    known = named.where("files = 1").select("symbol", "rows", "first", "last", F.lit("manifest").alias("source"))
    lacking = named.where(F.coalesce("files", F.lit(0)) == 0).select("symbol")
    scanned = archive.join(F.broadcast(lacking), "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("rows"), F.min(F.col(ts).cast("date")).alias("first"), F.max(F.col(ts).cast("date")).alias("last"))
    return known.unionByName(lacking.join(scanned, "symbol", "left").select("symbol", F.coalesce("rows", F.lit(0)).alias("rows"), "first", "last", F.lit("scan").alias("source")))


def with_source_path(spark: SparkSession, path: str, manifest: DataFrame, depth: int) -> DataFrame:
    """The rows of a partitioned archive with ``source_path``: where its manifest says that their folder's rows come from, NULL without an entry.

    ``manifest``: ``(file_key, source_path)``; a key is the last ``depth`` folders of a file's place, as
    ``symbol=A/month=2024-01``.
    """
    rows = spark.read.parquet(path).withColumn("file_key", F.regexp_extract("_metadata.file_path", rf"((?:[^/]+/){{{depth - 1}}}[^/]+)/[^/]+$", 1))
    return rows.join(manifest.select("file_key", "source_path"), "file_key", "left")


def funding(new: DataFrame, legacy: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Funding events with their source: of each symbol the new table's rows if it has any, else the legacy table's.

    ``new`` may lack a mark price, which the legacy table's row of the same ``keys`` fills (``marks``:
    keys and ``mark_price``). Every row keeps its ``source_path``.
    """
    filled = new.join(marks.withColumnRenamed("mark_price", "_mark"), keys, "left").withColumn("mark_price", F.coalesce("mark_price", "_mark")).drop("_mark")
    old = legacy.join(new.select("symbol").distinct(), "symbol", "left_anti")
    return filled.withColumn("origin", F.lit("new")).unionByName(old.withColumn("origin", F.lit("legacy")), allowMissingColumns=True)


def consolidated_coverage(consolidated: DataFrame, legacy: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows, first and last time per symbol, from consolidated rows where a symbol has any, else from the legacy table."""
    made = lambda df, source: df.groupBy("symbol").agg(F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last")).withColumn("source", F.lit(source))
    first = made(consolidated, "consolidated")
    return first.unionByName(made(legacy, "legacy").join(first.select("symbol"), "symbol", "left_anti"))


def catalog(tables: list[tuple[str, str | None, DataFrame]], per_symbol: bool = False, ts: str = "ts") -> DataFrame:
    """Per dataset and interval (and symbol, if asked for): symbols, rows, first and last time."""
    out = None
    for name, interval, df in tables:
        named = df.select("symbol", ts, F.lit(name).alias("dataset"), F.lit(interval).cast("string").alias("interval"))
        out = named if out is None else out.unionByName(named)
    by = ["dataset", "interval", *(["symbol"] if per_symbol else [])]
    counts = [] if per_symbol else [F.countDistinct("symbol").alias("symbols")]
    return out.groupBy(*by).agg(*counts, F.count("*").alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def write_partitioned(df: DataFrame, path: str, partition: str, spread: str = "ts", mode: str = "overwrite") -> None:
    """One folder a value of ``partition``; rows are spread by it and a salt, so that one large value has several files.

    Mode ``overwrite`` replaces the folders that ``df`` has rows for, and no other.
    """
    dealt = df.repartition(partition, F.pmod(F.xxhash64(spread), F.lit(8)))
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(partition).parquet(path)


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, keys: list[str], load: str, partition: str = "symbol") -> None:
    """Rows of ``new`` into a partitioned table, the last load of a key winning; only partitions that ``new`` has are read and rewritten.

    What they will hold is written to the shared folder first, so that no folder is replaced while
    it is read; then dynamic partition overwrite puts whole partitions in place.
    """
    touched = F.broadcast(new.select(partition).distinct().where(F.length(F.col(partition).cast("string")) >= 0))
    old = spark.read.parquet(path).join(touched, partition, "left_semi")
    merged = stored(upsert(old.select(*new.columns), new, keys, load))
    write_partitioned(merged, path, partition, spread=keys[-1])


def page(df: DataFrame, order: list[str], offset: int, limit: int, ranges: int = 256, most: int = 1 << 20) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order of numbers, with ``total``, the number of all rows.

    No sort of all rows: quantiles of the first column cut the rows into ranges, a count places the
    page in one or a few of them, and those alone are cut on, by the next column where a range has
    one value, until they have at most ``most`` rows or no column is left. The driver sees counts of
    ranges only. Rows without a value come first.
    """
    total = df.count()
    out = df.limit(0)
    for part, skip, take in _segments(df, [*order], offset, max(0, min(limit, total - offset)), total, ranges, max(most, limit)):
        out = out.unionByName(part.orderBy(*[F.asc_nulls_first(c) for c in order]).offset(skip).limit(take))
    return out.withColumn("total", F.lit(total))


def _segments(df: DataFrame, order: list[str], offset: int, limit: int, rows: int, ranges: int, most: int) -> list[tuple[DataFrame, int, int]]:
    """Parts of ``df`` that hold its rows ``offset`` to ``offset + limit``, with the rows to skip and take in each: small parts, or parts of rows that are equal in the whole order."""
    if limit <= 0:
        return []
    if rows <= most or not order:
        return [(df, offset, limit)]
    column = order[0]
    cuts = sorted({*(df.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or [])})
    # Rows that equal a cut are a range of their own, so that no range keeps more than its share but one of a single value.
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column))) + F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column))) if cuts else F.lit(0)
    place = F.when(F.col(column).isNull(), -1).otherwise(above)
    counts = df.groupBy(place.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
    found, seen = [], 0
    for r in sorted(counts, key=lambda r: r["at"]):
        skip, take = max(0, offset - seen), min(seen + r["n"], offset + limit) - max(seen, offset)
        if take > 0:
            part = df.where(place == r["at"])
            found += _segments(part, order[1:] if r["lo"] == r["hi"] else order, skip, take, r["n"], ranges, most)
        seen += r["n"]
    return found


def membership(spark: SparkSession, path: str, start: str, stop: str, warm_hours: int, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """A universe file as ``(timestamp, symbol, eligible)`` from the warm-up on, and the lines in quarantine: ``(line, reason)``.

    A line needs exactly three fields, a timestamp that names its zone and lies on the hour, a
    symbol, and one of the tokens ``true false 1 0``; the first fault counts. Keys that repeat
    are in quarantine with all their lines, as neither is known to be right.
    """
    schema = "timestamp string, symbol string, eligible string, line string"
    reader = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").option("columnPruning", False).option("enforceSchema", True)
    raw = reader.csv(path)
    token = F.lower(F.trim("eligible"))
    flag = F.when(token.isin("true", "1"), True).when(token.isin("false", "0"), False)
    zoned = F.trim("timestamp").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    at = F.when(zoned, F.col("timestamp").try_cast("timestamp"))
    plain = raw.select("*", at.alias("at"), flag.alias("flag"), F.concat_ws(",", F.coalesce("timestamp", F.lit("")), F.coalesce("symbol", F.lit("")), F.coalesce("eligible", F.lit(""))).alias("text"))
    reason = (
        F.when(F.col("line").isNotNull(), "malformed_line").when(~F.coalesce(zoned, F.lit(False)), "no_zone").when(F.col("at").isNull(), "bad_time").when(F.date_trunc("hour", "at") != F.col("at"), "off_hour")
        .when(F.trim(F.coalesce("symbol", F.lit(""))) == "", "no_symbol").when(F.col("flag").isNull(), "bad_token")
    )
    judged = plain.select(F.coalesce("line", "text").alias("line"), "at", "symbol", "flag", reason.alias("reason"))
    held = F.count(F.when(F.col("reason").isNull(), 1)).over(W.partitionBy("at", "symbol"))
    judged = judged.withColumn("reason", F.when(F.col("reason").isNull() & (held > 1), "repeated_key").otherwise(F.col("reason")))
    low = F.to_timestamp(F.lit(start)) - F.make_dt_interval(hours=F.lit(warm_hours))
    within = (F.col("at") >= low) & (F.col("at") < F.to_timestamp(F.lit(stop)))
    good = judged.where(F.col("reason").isNull() & within).select(F.col("at").alias("timestamp"), "symbol", F.col("flag").alias("eligible"))
    return good, judged.where("reason is not null").select("line", "reason")


def universe_faults(grid: DataFrame, aliases: DataFrame, ts: str = "ts", step: str = "INTERVAL 1 HOUR") -> DataFrame:
    """``(violation, symbol, ts, rows)`` of a universe: all checks of the grid through the alias map.

    ``grid``: ``(symbol, ts, eligible)``, ``aliases``: ``(alias, market)``. Symbols are resolved first.
    Violations: alias_duplicate (two names of one market at one time), repeated (one name twice
    at one time), off_hour, unknown_membership (null), missing (a market lacks a step), and
    never_eligible. One aggregate of a row a market and time gives all but the last two, which come
    from that aggregate's rows per market.
    """
    named = grid.join(aliases.select(F.col("alias").alias("symbol"), "market"), "symbol", "left").withColumn("market", F.coalesce("market", "symbol"))
    cells = named.groupBy("market", ts, "symbol").agg(F.count("*").alias("n"), F.count_if(F.col("eligible").isNull()).alias("unknown"), F.max(F.col("eligible").cast("int")).alias("any"))
    keys = cells.groupBy("market", ts).agg(F.count("*").alias("names"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("unknown").alias("unknown"), F.max("any").alias("any"))
    flags = F.array_compact(F.array(
        F.when(F.col("names") > 1, "alias_duplicate"), F.when(F.col("most") > 1, "repeated"), F.when(F.date_trunc("hour", ts).cast("timestamp_ntz") != F.col(ts), "off_hour"), F.when(F.col("unknown") > 0, "unknown_membership"),
    ))
    found = keys.select(F.explode(flags).alias("violation"), F.col("market").alias("symbol"), ts, F.col("n").alias("rows"))
    ends = keys.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).select(F.explode(F.sequence(F.date_trunc("hour", "lo").cast("timestamp_ntz"), "hi", F.expr(step))).alias(ts))
    each = keys.groupBy("market").agg(F.max("any").alias("any"), F.min(ts).alias(ts), F.sum("n").alias("n"))
    lacking = each.select("market").join(ends, how="cross").join(keys, ["market", ts], "left_anti").select(F.lit("missing").alias("violation"), F.col("market").alias("symbol"), ts, F.lit(0).cast("long").alias("rows"))
    never = each.where("coalesce(any, 0) = 0").select(F.lit("never_eligible").alias("violation"), F.col("market").alias("symbol"), ts, F.col("n").alias("rows"))
    return found.unionByName(lacking).unionByName(never)


def unique_times(events: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, rows)`` of events that share their key with another one; a sound source has none."""
    return events.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def complete_views(metrics: DataFrame, fields: list[str], tag: str) -> DataFrame:
    """Rows of metric snapshots that have all of ``fields``, tagged with their period."""
    return metrics.dropna("any", subset=fields).withColumn("period", F.lit(tag))
