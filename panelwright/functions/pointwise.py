"""Pointwise operators. A missing input or a result that isn't finite is NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x`` as a double, NULL where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def add(x: Column, y: Column) -> Column:
    return finite(x + y)


def sub(x: Column, y: Column) -> Column:
    return finite(x - y)


def mul(x: Column, y: Column) -> Column:
    return finite(x * y)


def div(x: Column, y: Column) -> Column:
    """NULL for a zero denominator."""
    return finite(F.try_divide(x.cast("double"), y.cast("double")))


def absolute(x: Column) -> Column:
    return finite(F.abs(x))


def neg(x: Column) -> Column:
    return finite(-x)


def sign(x: Column) -> Column:
    return finite(F.signum(x))


def smaller(x: Column, y: Column) -> Column:
    """NULL if either side is missing."""
    return F.when(x.isNotNull() & y.isNotNull(), finite(F.least(x, y)))


def larger(x: Column, y: Column) -> Column:
    """NULL if either side is missing."""
    return F.when(x.isNotNull() & y.isNotNull(), finite(F.greatest(x, y)))


def log(x: Column) -> Column:
    """NULL at zero and below."""
    return finite(F.when(x > 0, F.ln(x)))


def sqrt(x: Column) -> Column:
    """NULL below zero."""
    return finite(F.when(x >= 0, F.sqrt(x)))


def power(x: Column, exponent: float) -> Column:
    return finite(F.pow(x, F.lit(float(exponent))))


def bounded_ratio(ratio: Column) -> Column:
    """A ratio of two sides as a net share, (r - 1) / (r + 1)."""
    return div(ratio - 1, ratio + 1)


def annualized_funding(rate: Column, interval_hours: Column) -> Column:
    """A rate per funding interval as a rate per year of 365.25 days."""
    return div(rate * (24 * 365.25), interval_hours)


def log_return(x: Column, previous: Column) -> Column:
    return finite(log(x) - log(previous))


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda field: field.rlike(pattern)


def family(fields: Column, formula: Column) -> Column:
    """A formula's class from the fields and operators it uses, tested in a fixed order; mixed if none is typical.

    ``fields`` is an array of field names, ``formula`` the text. A formula over several kinds of
    fields is mixed; one over a dispersion operator is volatility; then price, volume, funding and
    positioning by its only kind.
    """
    kinds = {"price": "_(open|high|low|close)$", "volume": "volume|_trades$", "funding": "^funding_|premium", "positioning": "^(toptrader|global_account|open_interest)_"}
    has = {k: F.exists(fields, _matches(pattern)) for k, pattern in kinds.items()}
    number = sum((h.cast("int") for h in has.values()), F.lit(0))
    disperse = formula.contains("ts_std") | formula.contains("ts_cov")
    found = F.when(number > 1, "mixed").when(disperse & has["price"], "volatility")
    for kind in kinds:
        found = found.when(has[kind], kind)
    return found.otherwise("mixed")
