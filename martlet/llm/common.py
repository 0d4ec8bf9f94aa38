"""Helpers shared by the corpus operators: scratch tables, column picking, mixing hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.session import scratch_dir, scratch_path


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage there."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Only the named input columns, as ``name=(input column, type)``.

    Everything else is left behind, so that extra columns of any name and type
    cannot clash with names used inside an operator.
    """
    by_place = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return by_place.select(
        *(by_place[f"_{place(df, name)}"].cast(kind).alias(out) for out, (name, kind) in columns.items())
    )


def place(df: DataFrame, name: str) -> int:
    """Where the column is that is spelt exactly so, else one that differs in case only."""
    names = df.columns
    for at, c in enumerate(names):
        if c == name:
            return at
    for at, c in enumerate(names):
        if c.lower() == name.lower():
            return at
    raise ValueError(f"no column {name!r} among {names}")


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalising mix, over unsigned arrays."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``saved`` table that no later step reads."""
    spark = df.sparkSession
    root = scratch_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/martlet-" in path or path.startswith(root):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
