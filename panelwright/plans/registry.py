"""All registered queries of the library and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.plans import archives, comparison, details, evaluation, liquidation, panels, pointwise, portfolios, reports, signals, sources, windows  # noqa: F401  (they register)
from panelwright.plans.base import FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
