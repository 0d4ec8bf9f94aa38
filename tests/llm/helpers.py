"""Small fixtures for the corpus operators."""

from __future__ import annotations


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """``df`` with further columns whose names are used inside the operators."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(1) for c in ("node", "root", "name", "h", "v", "key", "copies", "_id", "_0", "n", "domain") if c not in df.columns}
    return df.withColumns(extra)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
