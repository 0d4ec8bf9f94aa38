"""Change from one period to another in a period series.

A series has one row per month (or other period): at most a few thousand rows,
already aggregated, so an unpartitioned window over it is cheap at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.functions import as_double

GUARDS = ("positive", "nonzero")


def month_index(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def same_period_before(value: str, month: str, months: int = 1) -> Column:
    """Value exactly ``months`` calendar months earlier; NULL if that month is absent.

    A RANGE frame one value wide, so no self-join is needed.
    """
    window = W.orderBy(month_index(F.col(month))).rangeBetween(-months, -months)
    return F.max(value).over(window)


def change_rate(current: Column, previous: Column, guard: str) -> Column:
    """Percentage change. ``positive`` gives NULL unless the previous value is above
    zero; ``nonzero`` only avoids dividing by zero."""
    if guard not in GUARDS:
        raise ValueError(f"unknown guard {guard!r}")
    rate = as_double(current - previous) / F.nullif(as_double(previous), F.lit(0.0)) * 100
    return F.when(previous > 0, rate) if guard == "positive" else rate


def period_change(
    df: DataFrame,
    order: list[str],
    value: str,
    into: str = "growth_rate",
    *,
    guard: str = "positive",
    calendar: bool = False,
) -> DataFrame:
    """``df`` with the change from the previous row in ``order``.

    By default the previous row is the previous month that is present. With
    ``calendar`` it is the previous calendar month, and ``order`` is one date column.
    """
    if calendar:
        previous = same_period_before(value, order[0])
    else:
        keys = [F.col(c).asc_nulls_last() for c in order]
        previous = F.lag(value, 1).over(W.orderBy(*keys))
    rows = df.withColumn("_previous", previous)
    return rows.withColumn(into, change_rate(F.col(value), F.col("_previous"), guard)).drop("_previous")
