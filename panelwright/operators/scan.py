"""Running measures along a symbol's rows in two levels: within buckets of time, and from bucket to bucket.

A window over a symbol alone puts all of its rows into one task. Here a task has the rows of one
symbol and bucket; what the buckets before hold comes from a window over one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.sources.tables import stored


def bucketed(df: DataFrame, keys: Sequence[str], time: str, bucket: str = "day") -> DataFrame:
    """``df`` with ``_bucket``, dealt by keys and bucket: what ``running`` needs, and keeps, so that one exchange serves several scans."""
    return df.withColumn("_bucket", F.date_trunc(bucket, F.col(time))).repartition(*keys, "_bucket")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], **measures: tuple[str, Column]) -> DataFrame:
    """``df``, which comes from ``bucketed``, with running measures of the key's rows so far in ``order``, the row itself included.

    A measure is a kind and a column: ``sum`` (nulls add nothing; 0 before any value), ``max``,
    ``min``, ``last`` (the latest value that isn't null), or ``previous`` (the row before's value,
    null or not, in a struct ``(value)`` that is null for a key's first row). The order begins with
    the time of the buckets. Keys aren't null; rows without a time come first.
    """
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    sofar = inside.rowsBetween(W.unboundedPreceding, 0)
    plain = {"sum": F.sum, "max": F.max, "min": F.min}

    def own(kind: str, x: Column) -> Column:
        if kind == "previous":
            return F.lag(F.struct(x.alias("value"))).over(inside)
        return F.last(x, True).over(sofar) if kind == "last" else plain[kind](x).over(sofar)

    there = df.withColumns({f"_own_{n}": own(kind, x) for n, (kind, x) in measures.items()})
    place = F.struct(*order)
    total = {"previous": lambda x: F.max_by(F.struct(x.alias("value")), place), "last": lambda x: F.max_by(x, F.when(x.isNotNull(), place)), **plain}
    last = df.groupBy(*keys, "_bucket").agg(*[total[kind](x).alias(f"_end_{n}") for n, (kind, x) in measures.items()])
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = {n: F.last(f"_end_{n}", True).over(before) if kind in ("last", "previous") else plain[kind](f"_end_{n}").over(before) for n, (kind, _) in measures.items()}
    carried = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), *[c.alias(f"_in_{n}") for n, c in carry.items()])
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    both = there.join(carried, same, "left")

    def joined(name: str, kind: str) -> Column:
        mine, early = F.col(f"_own_{name}"), F.col(f"_in_{name}")
        if kind == "sum":
            return F.coalesce(mine, F.lit(0)) + F.coalesce(early, F.lit(0))
        return F.greatest(mine, early) if kind == "max" else F.least(mine, early) if kind == "min" else F.coalesce(mine, early)

    return both.select(*df.columns, *[joined(n, kind).alias(n) for n, (kind, _) in measures.items()])


def compose(decay: np.ndarray, *gains: np.ndarray) -> tuple[np.ndarray, ...]:
    """The maps ``s -> a s + b`` of all rows so far, of each row: a parallel prefix over one decay and several gains."""
    a, bs = decay.astype(float), [g.astype(float) for g in gains]
    step = 1
    while step < len(a):
        bs = [np.concatenate([b[:step], b[step:] + a[step:] * b[:-step]]) for b in bs]
        a = np.concatenate([a[:step], a[step:] * a[:-step]])
        step *= 2
    return a, *bs


def _composed(rows: pd.DataFrame, order: list[str], names: list[str]) -> pd.DataFrame:
    rows = rows.sort_values(order, kind="stable")
    return rows.assign(**dict(zip(names, compose(*(rows[n].to_numpy(float) for n in names)), strict=True)))


def affine(df: DataFrame, keys: Sequence[str], order: str, decay: Column, **gains: Column) -> DataFrame:
    """``df``, which comes from ``bucketed``, with each gain's recursion ``s = decay * s + gain`` along the key's rows from 0 on.

    Affine maps compose: a task composes those of one key and bucket, another one those of a key's
    buckets, of which each is one row, and every row applies its own to what its bucket begins
    with. ``order`` is a column that is distinct within a key. The composed maps are written once.
    """
    names = ["_decay", *gains]
    slim = df.select(*keys, "_bucket", order, decay.cast("double").alias("_decay"), *[g.cast("double").alias(n) for n, g in gains.items()])
    kinds = dict(slim.dtypes)
    named = lambda columns: ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    rows = stored(slim.groupBy(*keys, "_bucket").applyInPandas(lambda part: _composed(part, [order], names), named(slim.columns)))
    totals = rows.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*names), order).alias("_t")).select(*keys, "_bucket", "_t.*")
    through = totals.groupBy(*keys).applyInPandas(lambda part: _composed(part, ["_bucket"], names), named([*keys, "_bucket", *names]))
    begin = W.partitionBy(*keys).orderBy("_bucket")
    carried = through.select(*keys, "_bucket", *[F.coalesce(F.lag(n).over(begin), F.lit(0.0)).alias(f"_in_{n}") for n in gains])
    found = rows.join(carried, [*keys, "_bucket"]).select(*keys, order, *[(F.col("_decay") * F.col(f"_in_{n}") + F.col(n)).alias(n) for n in gains])
    return df.join(found, [*keys, order])
