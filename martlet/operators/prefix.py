"""Sums over everything that sorts before a row, without one task seeing all rows.

A window with ORDER BY but no PARTITION BY moves its whole input to one task. That
is right for a series that is short by its nature, such as months, and wrong for
sellers. So the general form collapses ties by grouping on the sort value, cuts the
values into slices, sums each slice by itself, and lets the few slice totals carry
the sum from one slice to the next.

The cuts are percentiles of the values, one row of at most ``SLICES`` numbers. They
are a scalar subquery, so they are in the plan as literals: each branch and each
repeated task sees the same slices, and nothing is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 256


def sort_key(column: str, descending: bool) -> Column:
    """Nulls first when descending and last when ascending, as in the source database."""
    return F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()


def _joined(inner: Column, before: Column) -> Column:
    return F.coalesce(inner + before, inner, before)


def _in_one_task(df: DataFrame, order: str, value: Column, descending: bool) -> DataFrame:
    by_value = W.orderBy(sort_key(order, descending))
    upto = by_value.rangeBetween(W.unboundedPreceding, W.currentRow)
    ties = W.partitionBy(order)
    return df.select(
        "*",
        F.sum(value).over(upto).alias("_upto"),
        F.sum(value).over(ties).alias("_tied"),
        F.rank().over(by_value).cast("bigint").alias("_rank"),
        F.dense_rank().over(by_value).cast("bigint").alias("_dense_rank"),
    )


def _in_slices(df: DataFrame, order: str, value: Column, descending: bool, slices: int) -> DataFrame:
    key = sort_key("_key", descending)
    groups = df.groupBy(F.col(order).alias("_key")).agg(
        F.sum(value).alias("_weight"), F.count("*").alias("_rows")
    )
    at = [i / slices for i in range(1, slices)] or [0.5]
    # The other two fields make it read what the rows read, so that all share one shuffle.
    cuts = groups.agg(
        F.struct(F.percentile_approx("_key", at, 20 * slices).alias("at"), F.max("_weight"), F.max("_rows"))
    ).scalar()
    below = F.greatest(F.size(F.filter("_cuts", lambda c: c < F.col("_key"))), F.lit(0))
    place = F.coalesce(slices - below if descending else below, F.lit(0))
    nulls = -1 if descending else slices + 1
    placed = (
        groups.withColumn("_cuts", cuts["at"])
        .withColumn("_slice", F.when(F.col("_key").isNull(), nulls).otherwise(place))
        .drop("_cuts")
    )
    earlier = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = (
        placed.groupBy("_slice")
        .agg(F.sum("_weight").alias("w"), F.sum("_rows").alias("r"), F.count("*").alias("n"))
        .select(
            "_slice",
            F.sum("w").over(earlier).alias("_weight_before"),
            F.sum("r").over(earlier).alias("_rows_before"),
            F.sum("n").over(earlier).alias("_groups_before"),
        )
    )
    inside = W.partitionBy("_slice").orderBy(key)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows_upto = _joined(F.sum("_rows").over(upto), F.col("_rows_before"))
    sums = placed.join(before, "_slice").select(
        "_key",
        _joined(F.sum("_weight").over(upto), F.col("_weight_before")).alias("_upto"),
        F.col("_weight").alias("_tied"),
        (rows_upto - F.col("_rows") + 1).alias("_rank"),
        _joined(F.row_number().over(inside).cast("bigint"), F.col("_groups_before")).alias("_dense_rank"),
    )
    return df.join(sums, df[order].eqNullSafe(sums["_key"])).drop("_key")


def ordered_prefix(
    df: DataFrame,
    order: str,
    weight: str | None = None,
    *,
    descending: bool = False,
    short_series: bool = False,
    slices: int = SLICES,
) -> DataFrame:
    """``df`` plus, for each row, sums over all rows up to and including its ties.

    ``_upto``        sum of ``weight`` over rows sorting at or before this value
    ``_tied``        sum of ``weight`` over the rows tied with this one, itself included
    ``_rank``        1 + number of rows sorting before
    ``_dense_rank``  1 + number of distinct values sorting before

    ``order`` is a number, a date or a timestamp. ``short_series`` is for rows that
    are few by their nature (months), whatever the size of the data: one task sorts them.
    """
    value = F.lit(None).cast("bigint") if weight is None else F.col(weight)
    if short_series:
        return _in_one_task(df, order, value, descending)
    return _in_slices(df, order, value, descending, slices)
