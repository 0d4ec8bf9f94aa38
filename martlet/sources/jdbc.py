"""Partitioned read from a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    key: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Read ``table`` over JDBC; the driver jar must be on the class path.

    With ``key`` and its range the read is split into ``partitions`` range
    queries, one per task. Rows outside the range are still read: the bounds
    only place the cuts. Without a key one task reads the whole table, which suits
    dimensions; asking for more partitions without a key is an error.
    """
    return spark.read.format("jdbc").options(
        **jdbc_options(url, table, key, lower, upper, partitions, fetch_size, properties)
    ).load()


def jdbc_options(
    url: str,
    table: str,
    key: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    properties: dict[str, str] | None = None,
) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **(properties or {})}
    if key is None and partitions > 1:
        raise ValueError("a read in several partitions needs a key to cut the table by")
    if key is not None:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs the lower and upper key")
        options |= {
            "partitionColumn": key,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options
