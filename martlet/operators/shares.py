"""Comparison of rows with a figure over all rows, or over their group.

The figure is a scalar subquery: one value, computed by partial aggregation and
put into the plan as a literal. The rows keep their partitioning, and the
shuffle that feeds both sides runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions import above_average, as_double, percent_of


def share_of_total(df: DataFrame, value: str, into: str = "pct_of_total") -> DataFrame:
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(into, percent_of(F.col(value), total))


def group_share(df: DataFrame, group: str, value: str, into: str = "pct_of_group") -> DataFrame:
    """Share of the row's own group. Group totals are joined back rather than
    windowed, so a group with most of the rows is not sent to one task."""
    totals = df.groupBy(F.col(group).alias("_group")).agg(F.sum(value).alias("_total"))
    joined = df.join(totals, df[group].eqNullSafe(totals["_group"]))
    return joined.select(*df.columns, percent_of(F.col(value), F.col("_total")).alias(into))


def mean_of(value: str, count: Column | None = None) -> Column:
    """Mean of an exact total: sum as double over the number of non-null values."""
    n = F.count(value) if count is None else count
    return as_double(F.sum(value)) / F.nullif(n, F.lit(0))


def flag_above_average(df: DataFrame, value: str, into: str = "value_category") -> DataFrame:
    """Label each row against the mean over all rows; equal counts as below."""
    average = df.agg(mean_of(value)).scalar()
    return df.withColumn(into, above_average(as_double(F.col(value)), average))
