"""Labels that reports put next to the numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts reports are filtered by.
ABOVE = "Above Average"
BELOW = "Below Average"
GREEN = "green"
AMBER = "amber"
RED = "red"
UP = "up"
DOWN = "down"
NOT_AVAILABLE = "N/A"


def above_average(value: Column, average: Column) -> Column:
    """Strictly above; equal or NULL counts as below."""
    return F.when(value > average, ABOVE).otherwise(BELOW)


def above_average_badge(category: Column) -> Column:
    return F.when(category == ABOVE, GREEN).otherwise(AMBER)


def rank_tier(rank: Column, green_to: int = 3, amber_to: int = 5) -> Column:
    return F.when(rank <= green_to, GREEN).when(rank <= amber_to, AMBER).otherwise(RED)


def growth_direction(growth: Column) -> Column:
    return F.when(growth >= 0, UP).otherwise(DOWN)


def full_name(first: Column, last: Column) -> Column:
    """NULL when either part is NULL."""
    return F.concat(first, F.lit(" "), last)


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yyyy")


def currency_label(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def percent_label(value: Column) -> Column:
    return F.format_string("%.1f%%", value)


def signed_percent_label(value: Column) -> Column:
    return F.when(value.isNull(), NOT_AVAILABLE).otherwise(F.format_string("%+.1f%%", value))
