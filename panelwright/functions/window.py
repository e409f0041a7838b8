"""Rolling operators over one symbol's dense time grid.

A window is exactly ``n`` steps, the current one included, and all ``n`` values must be present;
otherwise the result is NULL. Frames count rows, so a panel's grid must have every step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from panelwright.functions.pointwise import div, finite
from panelwright.operators import scan


def series(*keys: str, time: str = "ts") -> WindowSpec:
    """One symbol's rows in time order."""
    return W.partitionBy(*(keys or ("symbol",))).orderBy(time)


def _full(value: Column, x: Column, n: int, over: WindowSpec) -> Column:
    """``value`` over the last ``n`` rows, if ``x`` is present in all of them."""
    frame = over.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, finite(value.over(frame)))


def ts_delay(x: Column, n: int, over: WindowSpec) -> Column:
    return F.lag(x, n).over(over)


def ts_delta(x: Column, n: int, over: WindowSpec) -> Column:
    return finite(x - F.lag(x, n).over(over))


def ts_return(x: Column, n: int, over: WindowSpec) -> Column:
    """NULL for a zero base."""
    return div(x, F.lag(x, n).over(over)) - 1


def ts_mean(x: Column, n: int, over: WindowSpec) -> Column:
    return _full(F.avg(x), x, n, over)


def ts_sum(x: Column, n: int, over: WindowSpec) -> Column:
    return _full(F.sum(x), x, n, over)


def ts_min(x: Column, n: int, over: WindowSpec) -> Column:
    return _full(F.min(x), x, n, over)


def ts_max(x: Column, n: int, over: WindowSpec) -> Column:
    return _full(F.max(x), x, n, over)


def ts_std(x: Column, n: int, over: WindowSpec) -> Column:
    """Population standard deviation."""
    return _full(F.stddev_pop(x), x, n, over)


def ts_cov(x: Column, y: Column, n: int, over: WindowSpec) -> Column:
    """Population covariance of complete pairs."""
    return _full(F.covar_pop(x, y), F.when(y.isNotNull(), x), n, over)


def ts_corr(x: Column, y: Column, n: int, over: WindowSpec) -> Column:
    """NULL where either side doesn't vary."""
    both = F.when(y.isNotNull(), x)
    frame = over.rowsBetween(1 - n, 0)
    varies = (F.min(x).over(frame) < F.max(x).over(frame)) & (F.min(y).over(frame) < F.max(y).over(frame))
    value = div(F.covar_pop(x, y).over(frame), F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame))
    return F.when((F.count(both).over(frame) == n) & varies, value)


def ts_rank(x: Column, n: int, over: WindowSpec) -> Column:
    """The current value's place among the window's: (average rank - 1) / (n - 1)."""
    if n < 2:
        return F.lit(None).cast("double")
    held = F.collect_list(x).over(over.rowsBetween(1 - n, 0))
    below = F.size(F.filter(held, lambda v: v < x))
    ties = F.size(F.filter(held, lambda v: v == x))
    return F.when((F.size(held) == n) & x.isNotNull(), (below + (ties + F.lit(1)) / F.lit(2.0) - 1) / F.lit(float(n - 1)))


def previous_donchian(high: Column, low: Column, n: int, over: WindowSpec) -> tuple[Column, Column]:
    """The highest high and lowest low of the ``n`` rows before the current one."""
    frame = over.rowsBetween(-n, -1)
    return F.when(F.count(high).over(frame) == n, F.max(high).over(frame)), F.when(F.count(low).over(frame) == n, F.min(low).over(frame))


def zscore(x: Column, n: int, over: WindowSpec) -> Column:
    """NULL where the window doesn't vary."""
    sd = ts_std(x, n, over)
    return div(x - ts_mean(x, n, over), F.when(sd > 0, sd))


def wilder_means(rows: DataFrame, n: int, keys: Sequence[str], time: str, bucket: str = "day") -> DataFrame:
    """``rows`` with ``seen``, ``gain`` and ``loss``: changes of ``x`` so far since the last row without one, and Wilder's means of their rises and falls.

    ``rows`` has ``x`` and, in a row that states what was before all others of its key, that row's
    ``seen0``, ``gain0`` and ``loss0`` (null elsewhere). Means start as those of ``n`` changes and then
    move by 1/n. Each is an affine map of the one before, and maps compose, so that a key's rows
    spread over tasks by buckets of time. Times of a key are distinct.
    """
    dealt = scan.running(scan.bucketed(rows, keys, time, bucket), keys, [time], _before=("previous", F.col("x")), _at=("sum", F.lit(1)))
    moved = dealt.withColumn("_change", F.col("x") - F.col("_before.value"))
    start = F.when(F.col("_change").isNull(), F.struct(F.col("_at").alias("at"), F.coalesce("seen0", F.lit(0)).cast("long").alias("seen")))
    moved = scan.running(moved, keys, [time], _start=("max", start)).withColumn("seen", F.col("_at") - F.col("_start.at") + F.col("_start.seen"))
    fresh = F.col("_change").isNull()
    decay = F.when(fresh, 0.0).when(F.col("seen") <= n, 1.0).otherwise(1 - 1 / n)
    sides = {"gain": F.col("_change"), "loss": -F.col("_change")}
    gains = {name: F.when(fresh, F.coalesce(f"{name}0", F.lit(0.0))).otherwise(F.greatest(side, F.lit(0.0)) / n) for name, side in sides.items()}
    return scan.affine(moved, keys, time, decay, **gains).select(*rows.columns, "seen", "gain", "loss")


def wilder_index(n: int) -> Column:
    """The index of a row of ``wilder_means``: NULL before ``n`` changes, 50 where nothing has moved."""
    both = F.col("gain") + F.col("loss")
    return F.when(F.col("x").isNotNull() & (F.col("seen") >= n), F.when(both == 0, 50.0).otherwise(F.try_divide(100 * F.col("gain"), both)))


def ts_rsi(df: DataFrame, x: str, n: int, name: str = "rsi", symbol: str = "symbol", time: str = "ts", bucket: str = "month") -> DataFrame:
    """``df`` with Wilder's relative strength index of ``x``; a row without a value starts it anew.

    A symbol of any length spreads over tasks, one for each ``bucket`` of time. Rows of a symbol
    have distinct times.
    """
    slim = df.select(symbol, time, finite(F.col(x).cast("double")).alias("x"), *[F.lit(None).cast("double").alias(c) for c in ("seen0", "gain0", "loss0")])
    found = wilder_means(slim, n, [symbol], time, bucket).select(symbol, time, wilder_index(n).alias(name))
    return df.join(found, [symbol, time], "left")


def lookback(operator: str, n: int, *inner: int) -> int:
    """Rows of history that an operator over windows of ``n`` needs beyond its arguments' own."""
    own = n if operator in ("ts_delay", "ts_delta", "ts_return", "ts_rsi") else n - 1
    return own + max(inner, default=0)
