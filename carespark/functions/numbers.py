"""Exact averages, safe ratios and number text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXACT = "decimal(18,6)"


def exact(col) -> Column:
    """Decimal copy of a measurement: sums do not depend on row order."""
    return (F.col(col) if isinstance(col, str) else col).cast(EXACT)


def mean(col, digits: int) -> Column:
    return F.round(F.avg(exact(col)), digits).cast("double")


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """Division that yields `default` for a zero or missing denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(default))


def percent(num: Column, den: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * num, den.cast("double")), digits)


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(F.lit(0).cast("decimal(18,2)")))


def distinct_if(cond: Column, value: Column) -> Column:
    return F.count_distinct(F.when(cond, value))


def plain(col: Column) -> Column:
    """Number as text without exponent or trailing zeros."""
    return F.regexp_replace(col.cast("decimal(24,6)").cast("string"), r"\.?0+$", "")
