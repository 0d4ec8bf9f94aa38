"""Typed table reads, views, SQL text, catalogue listing, previews."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.sources.schemas import RETAIL, TableSpec


def read_tables(
    spark: SparkSession, root: str, specs: Mapping[str, TableSpec] = RETAIL
) -> dict[str, DataFrame]:
    """Every declared table under ``root/<name>``, read with its declared schema."""
    return {n: spark.read.schema(s.schema).parquet(f"{root}/{n}") for n, s in specs.items()}


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_query(
    spark: SparkSession, sql: str, params: Mapping[str, object] | None = None, tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Run SQL text with named parameters (``:name``).

    Tables given by name stand for ``{name}`` in the text; no view of the session is
    made or replaced for them.
    """
    return spark.sql(sql, args=dict(params) if params else None, **(tables or {}))


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Name and type of the tables and views of a database, session views included."""
    kinds = {"MANAGED": "BASE TABLE", "EXTERNAL": "BASE TABLE", "VIEW": "VIEW", "TEMPORARY": "VIEW"}
    rows = [
        (t.name, kinds[t.tableType])
        for t in spark.catalog.listTables(database)
        if t.tableType in kinds
    ]
    return spark.createDataFrame(rows, "name string, type string").orderBy("name")


def preview(df: DataFrame, key: str | Iterable[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by key, so that a preview is repeatable."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(n)
