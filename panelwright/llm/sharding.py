"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, subdivided ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.runtime import checkpoint

#: Ranges that the splitters bound, rows that the sample is meant to have, bytes and rows above which a range is subdivided.
RANGES, SAMPLE_ROWS, RANGE_BYTES, RANGE_ROWS = 256, 50_000, 64 << 20, 1_000_000


def _range_of(key: Column, splitters: list[int], first: int = 0) -> Column:
    """The number of splitters at or below ``key``, found by bisection inside generated code."""
    if not splitters:
        return F.lit(first)
    middle = len(splitters) // 2
    return F.when(key < F.lit(splitters[middle]), _range_of(key, splitters[:middle], first)).otherwise(_range_of(key, splitters[middle + 1 :], first + middle + 1))


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``: every row once, shards near equal in bytes.

    ``size`` is the text's UTF-8 length plus one. Rows are keyed by a hash of the text, so equal
    texts are neighbours. A sample in which a row's chance grows with its size (``SAMPLE_ROWS``
    expected) gives the splitters of ``RANGES`` ranges of about equal bytes; a range that holds
    more than ``RANGE_BYTES`` or ``RANGE_ROWS``, be it by scale or because one text fills it, is
    subdivided by a hash of the row, which differs between rows that repeat. Exact totals of these cells give each row its byte offset in the order of all
    rows, and a shard is one n-th of the bytes: two shards differ by one row's size at most,
    whatever the sample was. ``slot`` numbers a shard's rows from 0.

    Null text: size 1, checksum of the empty string. Null ids, ties and repeated rows are rows like
    any other. A long text counts whole and goes to one shard. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = checkpoint(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("key"),
            F.monotonically_increasing_id().alias("salt"),  # fixed as the rows are written; tells rows apart that repeat
        )
    )
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], f"doc_id {dict(rows.dtypes)['doc_id']}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
    chance = F.pmod(F.xxhash64("doc_id", "key", F.lit(1)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    quantiles = [i / RANGES for i in range(1, RANGES)]
    sample = rows.where(chance < F.col("size") * F.lit(SAMPLE_ROWS / total))
    splitters = sorted(set(sample.agg(F.percentile_approx("key", quantiles, 10_000)).first()[0] or []))
    ranged = rows.withColumn("range", _range_of(F.col("key"), splitters))
    found = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    held = {i: r["bytes"] for i, r in found.items()}
    parts = [max(1, -(-held[i] // RANGE_BYTES), -(-found[i]["rows"] // RANGE_ROWS)) if i in found else 1 for i in range(len(splitters) + 1)]
    celled = ranged.withColumn("part", F.pmod(F.xxhash64("doc_id", "key", "salt"), F.element_at(F.array(*map(F.lit, parts)), F.col("range") + 1)).cast("int"))

    starts, before = [], 0
    for i in range(len(splitters) + 1):
        starts.append(before)
        before += held.get(i, 0)
    cells = celled.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = W.partitionBy("range").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(
        F.col("range"), F.col("part"), "rows",
        (F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("range") + 1) + F.coalesce(F.sum("bytes").over(earlier), F.lit(0))).alias("start"),
    )
    order = W.partitionBy("range", "part").orderBy("key", "doc_id", "text_crc32", "size")
    placed = (
        celled.withColumn("nth", F.row_number().over(order).cast("long"))
        .withColumn("through", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .join(cells.select("range", "part", "start"), ["range", "part"])
        .withColumn("shard", F.least(F.expr(f"((start + through - size) * {n_shards}) div {total}"), F.lit(n_shards - 1)).cast("int"))
        .select("doc_id", "size", "text_crc32", "range", "part", "nth", "shard")
    )
    placed = checkpoint(placed)
    # A cell's rows of one shard are consecutive: their first number and count place them among the shard's rows.
    pieces = placed.groupBy("shard", "range", "part").agg(F.min("nth").alias("first"), F.count("*").alias("rows"))
    ahead = W.partitionBy("shard", "range").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    by_range = pieces.groupBy("shard", "range").agg(F.sum("rows").alias("rows"))
    lead = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    by_range = by_range.select("shard", "range", F.coalesce(F.sum("rows").over(lead), F.lit(0)).alias("ahead_ranges"))
    pieces = pieces.withColumn("ahead_parts", F.coalesce(F.sum("rows").over(ahead), F.lit(0))).join(by_range, ["shard", "range"])
    return placed.join(pieces, ["shard", "range", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("ahead_ranges") + F.col("ahead_parts") + F.col("nth") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
