"""Cross-section operators: over the eligible symbols with a value at one time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.functions.pointwise import div


def average_rank(x: Column, *keys: Column | str) -> Column:
    """Rank of ``x`` within ``keys`` from 1, ties averaged; NULL where ``x`` is, which takes no rank.

    NULLs sort last, so that all ranks over the same keys share one exchange.
    """
    ties = F.count(F.lit(1)).over(W.partitionBy(*keys, x))
    return F.when(x.isNotNull(), F.rank().over(W.partitionBy(*keys).orderBy(x.asc_nulls_last())) + (ties - 1) / F.lit(2.0))


def members(x: Column, *keys: Column | str) -> Column:
    return F.count(x).over(W.partitionBy(*keys))


def distinct_members(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """Distinct values of ``x`` per key."""
    return df.groupBy(*keys).agg(F.countDistinct(x).alias("distinct"))


def cross_rank(df: DataFrame, x: str, name: str, time: str = "ts", eligible: str = "eligible") -> DataFrame:
    """(average rank - 1) / (n - 1) among eligible values at a time; NULL with fewer than two."""
    seen = df.withColumn("_x", F.when(F.col(eligible), F.col(x)))
    seen = seen.withColumns({"_rank": average_rank(F.col("_x"), time), "_n": members(F.col("_x"), time)})
    value = F.when(F.col("_x").isNotNull() & (F.col("_n") >= 2), (F.col("_rank") - 1) / (F.col("_n") - 1))
    return seen.withColumn(name, value).drop("_x", "_rank", "_n")


def cross_pct(df: DataFrame, x: str, name: str, time: str = "ts", eligible: str = "eligible") -> DataFrame:
    return cross_rank(df, x, name, time, eligible).withColumn(name, F.col(name) * 100)


def cross_zscore(df: DataFrame, x: str, name: str, time: str = "ts", eligible: str = "eligible") -> DataFrame:
    """Distance from the mean in population standard deviations; NULL where values don't vary."""
    at = W.partitionBy(time)
    seen = df.withColumn("_x", F.when(F.col(eligible), F.col(x)))
    varies = F.min("_x").over(at) < F.max("_x").over(at)
    value = F.when(varies, div(F.col("_x") - F.avg("_x").over(at), F.stddev_pop("_x").over(at)))
    return seen.withColumn(name, value).drop("_x")


def masked(x: Column, eligible: Column) -> Column:
    return F.when(eligible, x)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation of complete pairs, NULL where a side doesn't vary."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varies, div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
