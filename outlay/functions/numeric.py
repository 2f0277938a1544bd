"""Column helpers for money, ratios and rounding.

Stored amounts stay decimal, so sums do not depend on the order of rows. Ratios are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"
RATE = "decimal(14,4)"


def as_double(col: Column) -> Column:
    return col.cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null when den is zero."""
    return as_double(num) / F.nullif(as_double(den), F.lit(0.0))


def half_up(col: Column, digits: int) -> Column:
    """Round a double to `digits` places; ties go away from zero. Same bits in any IEEE engine."""
    unit = float(10**digits)
    size = F.floor(F.abs(col) * unit + 0.5).cast("double") / unit
    return F.signum(col) * size + F.lit(0.0)


def percent(num: Column, den: Column, digits: int) -> Column:
    """100 * num / den, rounded; null when den is zero."""
    return half_up(100.0 * ratio(num, den), digits)


def sum_if(cond: Column, value: Column) -> Column:
    """Sum of value over rows where cond holds, 0 elsewhere (also where cond is null)."""
    return F.sum(F.when(cond, value).otherwise(F.lit(0).cast("decimal(1,0)")))


def count_if(cond: Column) -> Column:
    """Rows where cond holds; 0, not null, on empty input."""
    return F.count(F.when(cond, F.lit(1)))
