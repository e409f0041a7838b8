"""Choosing rows and counting what is there: members a time, fronts, disjoint samples of classes, conditional coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def members(df: DataFrame, member: Column, ts: str = "ts") -> DataFrame:
    """``(ts, members)``: rows of each time for which a condition holds; one that is NULL doesn't."""
    return df.groupBy(ts).agg(F.count_if(F.coalesce(member, F.lit(False))).alias("members"))


def thin_times(counts: DataFrame, least: int, period: str = "day", ts: str = "ts") -> DataFrame:
    """Per period: times, times with fewer than ``least`` members, the fewest and the most; ``counts`` comes from ``members``."""
    name = F.date_trunc(period, ts).cast("timestamp_ntz").alias(period)
    return counts.groupBy(name).agg(F.count("*").alias("hours"), F.count_if(F.col("members") < least).alias("below_minimum"), F.min("members").alias("fewest"), F.max("members").alias("most"))


def front(df: DataFrame, parent: str, variant: str, score: str, digits: int = 3) -> DataFrame:
    """``(parent, variant, score)``: of each parent the variant with the lowest mean score, ties by the variant's name.

    Means are compared as rounded to ``digits``, so that a tie is one in spite of the order of sums.
    A variant without a score comes after all others.
    """
    means = df.groupBy(parent, variant).agg(F.round(F.avg(score), digits).alias("_score"))
    best = means.groupBy(parent).agg(F.min(F.struct(F.col("_score").isNull().alias("none"), "_score", variant)).alias("_best"))
    return best.select(parent, F.col(f"_best.{variant}").alias(variant), F.col("_best._score").alias(score))


def disjoint_picks(df: DataFrame, by: str, order: list[Column | str], first: int, more: int) -> DataFrame:
    """``df``'s first rows of each class in an order, and the ``more`` after those, which ``disjoint`` marks.

    A rank below a bound is taken before rows are dealt out by class, so a class of any size sends
    ``first + more`` rows from each task. The order should settle ties.
    """
    ranked = df.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_k") <= first + more)
    return ranked.withColumn("disjoint", F.col("_k") > first).drop("_k")


def conditional_coverage(df: DataFrame, keys: list[Column | str], groups: dict[str, Column], ts: str = "ts") -> DataFrame:
    """Per key and group of fields: rows for which the group's condition holds, and their first and last time."""
    made = []
    for name, there in groups.items():
        at = F.when(there, F.col(ts))
        made += [F.count_if(F.coalesce(there, F.lit(False))).alias(f"{name}_rows"), F.min(at).alias(f"{name}_first"), F.max(at).alias(f"{name}_last")]
    return df.groupBy(*keys).agg(*made)
