"""Cross-sectional correlation of many factors with each other, from blocked Gram sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Factors of a block: a pair of blocks is one matrix product a time.
BLOCK = 32


def gram_correlations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common rows and correlation of every column of ``x`` with every column of ``y``, NaN for missing values.

    Six sums of each pair (rows, both values, their squares and product) are matrix products of
    values and masks. A correlation is NaN where a side doesn't vary on the common rows; where the
    sums can't tell that from rounding, the rows are looked at.
    """
    mx, my = ~np.isnan(x), ~np.isnan(y)
    centred = [np.where(m, v - (np.where(m, v, 0).sum(0) / np.maximum(m.sum(0), 1)), 0.0) for v, m in ((x, mx), (y, my))]
    (cx, cy), fx, fy = centred, mx.astype(float), my.astype(float)
    n = fx.T @ fy
    some = np.maximum(n, 1)
    sx, sy, sxx, syy, sxy = cx.T @ fy / some, fx.T @ cy / some, (cx**2).T @ fy / some, fx.T @ cy**2 / some, cx.T @ cy / some
    vx, vy = sxx - sx**2, syy - sy**2
    unclear = (n > 0) & ((vx <= 1e-9 * sxx) | (vy <= 1e-9 * syy))
    with np.errstate(all="ignore"):
        r = np.where(unclear, np.nan, (sxy - sx * sy) / np.sqrt(np.where(unclear, 1.0, vx * vy)))
    for i, j in np.argwhere(unclear):
        both = mx[:, i] & my[:, j]
        a, b = x[both, i], y[both, j]
        if a.min() < a.max() and b.min() < b.max():
            a, b = a - a.mean(), b - b.mean()
            r[i, j] = (a @ b) / np.sqrt((a @ a) * (b @ b))
    r[n == 0] = np.nan
    return n, r


_OUT = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("insufficient", pa.int64()), ("constant", pa.int64()), ("valid", pa.int64()), ("total", pa.float64())])


def _products(block: int, min_symbols: int) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        a, b = part["a"][0].as_py(), part["b"][0].as_py()
        x, y = (part[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, block) for c in ("x", "y"))
        times = part["t"].to_numpy()
        order = np.argsort(times, kind="stable")
        cuts = np.flatnonzero(np.diff(times[order])) + 1
        counts = np.zeros((3, block, block), np.int64)
        total = np.zeros((block, block))
        for rows in np.split(order, cuts):
            n, r = gram_correlations(x[rows], y[rows])
            enough, there = n >= min_symbols, ~np.isnan(r)
            counts += np.stack([(n > 0) & ~enough, enough & ~there, enough & there])
            total += np.where(enough & there, r, 0.0)
        i, j = np.indices((block, block))
        i, j = i + a * block, j + b * block
        keep = (i < j) & (counts.sum(0) > 0)
        columns = [i[keep].astype(np.int32), j[keep].astype(np.int32), *(c[keep] for c in counts), total[keep]]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _OUT.types, strict=True)], schema=_OUT)

    return run


def pair_counts(long: DataFrame, min_symbols: int, bucket: str = "week", block: int = BLOCK) -> DataFrame:
    """Per pair of factors with a common cell: times with too few common symbols, without variation, and valid ones, and the sum of their correlations.

    ``long``: ``(factor, ts, symbol, value)``, one row a cell. The cells of one time and symbol become one vector of
    all factors, cut into blocks; each pair of blocks is a matrix product per time, in a task for
    each pair of blocks and ``bucket`` of time. So 200 factors make 28 rows a cell in place of
    19,900 pairs, and nothing is joined with itself.
    """
    live = long.where("value is not null")
    names = live.select("factor").distinct().withColumn("idx", F.row_number().over(W.orderBy("factor")) - 1)
    blocks = -(-names.count() // block)
    cells = live.join(names, "factor").groupBy("ts", "symbol").agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("v"))
    vectors = cells.select("ts", F.transform(F.sequence(F.lit(0), F.lit(max(blocks, 1) * block - 1)), lambda i: F.try_element_at("v", i)).alias("v"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(max(blocks, 1)) for b in range(a, max(blocks, 1))])
    part = lambda c: F.slice("v", F.col(f"p.{c}") * block + 1, F.lit(block))
    dealt = vectors.withColumn("p", F.explode(pairs)).select("p.a", "p.b", F.date_trunc(bucket, "ts").alias("bucket"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), part("a").alias("x"), part("b").alias("y"))
    made = dealt.groupBy("a", "b", "bucket").applyInArrow(_products(block, min_symbols), "i int, j int, insufficient bigint, constant bigint, valid bigint, total double")
    summed = made.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("insufficient", "constant", "valid", "total")])
    left, right = names.select(F.col("idx").alias("i"), F.col("factor").alias("left")), names.select(F.col("idx").alias("j"), F.col("factor").alias("right"))
    return summed.join(left, "i").join(right, "j").drop("i", "j")
