"""Writers for results and for co-located fact tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Overwrite ``path`` with Parquet.

    A partitioned write first brings rows of a partition value together, so that
    tasks write few files; the rebalance splits a value that holds too many rows.
    """
    columns = list(partition_by)
    if columns:
        df = df.hint("rebalance", *columns)
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Save ``df`` bucketed and sorted on ``key``.

    Orders and lines saved with the same bucket count join, and lines group, on
    the order key without any exchange. One task reads a whole bucket, so use it
    only on keys without a hot value; ``plans.quality.duplicate_keys`` tells.
    """
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
