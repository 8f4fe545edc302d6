"""Arithmetic shared by all rules.

Rounding is half-up through ``floor(x * 10^d + 0.5)``: Python, Spark and DuckDB disagree on ``round`` at
ties, but compute this expression identically.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(value: Column | str) -> Column:
    """Column as double."""
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def half_up(value: Column, digits: int) -> Column:
    scale = F.lit(float(10**digits))
    return F.floor(value.cast("double") * scale + F.lit(0.5)) / scale


def cents(value: Column) -> Column:
    """DECIMAL(p,2) money as exact integer cents."""
    return (value * 100).cast("bigint")


def ratio_or_zero(top: Column, bottom: Column, digits: int = 4) -> Column:
    """Quotient, 0 when the denominator is missing or 0."""
    bottom = bottom.cast("double")
    usable = bottom.isNotNull() & (bottom != 0)
    return F.when(usable, half_up(top.cast("double") / F.when(usable, bottom), digits)).otherwise(F.lit(0.0))


def finite_or_zero(value: Column) -> Column:
    """NaN, null and infinities become 0."""
    value = value.cast("double")
    broken = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(broken, F.lit(0.0)).otherwise(value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value.cast("double")))


def points(*rules: tuple[Column, float]) -> Column:
    """Points of the first rule that holds, else 0."""
    expr = None
    for test, value in rules:
        expr = F.when(test, F.lit(float(value))) if expr is None else expr.when(test, F.lit(float(value)))
    return expr.otherwise(F.lit(0.0))
