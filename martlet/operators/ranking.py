"""Rank, running total, top-n per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.operators.prefix import ordered_prefix


def rank_by(
    df: DataFrame,
    order: str,
    into: str = "rank",
    *,
    method: str = "rank",
    descending: bool = True,
    short_series: bool = False,
) -> DataFrame:
    """Rank of each row over the whole of ``df``; ties share a rank.

    ``method`` is ``rank`` (gaps after ties) or ``dense``.
    """
    if method not in ("rank", "dense"):
        raise ValueError(f"unknown rank method {method!r}")
    sums = ordered_prefix(df, order, descending=descending, short_series=short_series)
    rank = "_dense_rank" if method == "dense" else "_rank"
    return sums.select(*df.columns, F.col(rank).alias(into))


def running_total(
    df: DataFrame,
    order: str,
    value: str,
    into: str = "running_total",
    *,
    descending: bool = False,
    short_series: bool = False,
) -> DataFrame:
    """Sum of ``value`` over all rows up to this one; tied rows share the sum."""
    sums = ordered_prefix(df, order, value, descending=descending, short_series=short_series)
    return sums.select(*df.columns, F.col("_upto").alias(into))


def top_n_per_group(
    df: DataFrame, group: str, order: str, tiebreak: str, n: int, into: str = "rn"
) -> DataFrame:
    """The ``n`` largest rows of each group.

    The filter on the row number becomes a group limit ahead of the shuffle: each
    task sends at most ``n`` rows per group, however large the group is.
    """
    window = W.partitionBy(group).orderBy(F.col(order).desc_nulls_first(), F.col(tiebreak).asc_nulls_last())
    return df.withColumn(into, F.row_number().over(window).cast("bigint")).filter(F.col(into) <= n)
