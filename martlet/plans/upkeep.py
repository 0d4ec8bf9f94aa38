"""Results that are kept and brought up to date instead of being computed again.

Months: the totals of a month are stored in a folder of its own. New orders touch some
months; only these are computed again and replaced, and running totals and growth come
from the stored months. Replacing, not adding, makes a repeated append harmless.

Labels: order values are stored in slices by size, next to the totals of each day. When
the average moves, the orders whose label changes have values between the old and the
new average, so that only the slices between the two are read.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.functions import above_average, as_double
from martlet.functions.measures import MONEY
from martlet.operators import running_total
from martlet.plans.analyses import with_double
from martlet.plans.totals import order_values
from martlet.session import scratch_path
from martlet.sources.star import Star

#: Slices for each doubling of the value.
SLICES_PER_DOUBLING = 8


# --- months --------------------------------------------------------------------


def _month_partials(star: Star) -> DataFrame:
    month = F.trunc("order_date", "month").alias("month")
    sums = order_values(star).groupBy(month)
    return sums.agg(F.sum("order_value").cast(MONEY).alias("total_sales"), F.count("*").alias("order_count"))


def _write_months(star: Star, path: str) -> None:
    # Only folders of months that are written are replaced.
    writer = _month_partials(star).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("month").parquet(path)


def store_months(star: Star, path: str) -> None:
    """Totals of all months, one folder each."""
    _write_months(star, path)


def append_months(star: Star, added: DataFrame, path: str) -> list[dt.date | None]:
    """Bring the stored months up to date after ``added`` orders (a column ``order_date``) came in.

    ``star`` has old and new orders. Returns the months that were computed again; there
    are as many as the new orders touch.
    """
    touched = added.select(F.trunc("order_date", "month").alias("month")).distinct()
    months = sorted((r.month for r in touched.collect()), key=lambda m: (m is None, m or dt.date.max))
    if not months:
        return []
    inside = F.lit(False)
    for month in months:
        day = F.col("order_date")
        after = F.add_months(F.lit(month), 1)
        inside = inside | (day.isNull() if month is None else (day >= F.lit(month)) & (day < after))
    orders = star.orders.filter(inside)
    lines = star.lines.join(orders.select("order_id"), "order_id", "left_semi")
    _write_months(star.with_tables(orders=orders, lines=lines), path)
    return months


def stored_months(spark: SparkSession, path: str) -> DataFrame:
    """``month`` and exact ``total_sales`` of the stored months."""
    rows = spark.read.schema(f"total_sales {MONEY}, order_count bigint, month date").parquet(path)
    return rows.select("month", "total_sales")


def monthly_after_append(star: Star, days: int = 100) -> DataFrame:
    """Monthly sales and running total after the orders of the last ``days`` days were appended to the others."""
    spark = star.orders.sparkSession
    path = scratch_path(spark, "months")
    last = star.orders.agg(F.max("order_date")).first()[0]
    new = F.lit(False) if last is None else F.col("order_date") > F.lit(last - dt.timedelta(days=days))
    old = star.orders.filter(F.col("order_date").isNull() | ~new)
    store_months(star.with_tables(orders=old), path)
    append_months(star, star.orders.filter(new), path)
    running = running_total(stored_months(spark, path), "month", "total_sales", short_series=True)
    return with_double(running, "total_sales", "running_total").orderBy(F.col("month").asc_nulls_last())


# --- labels --------------------------------------------------------------------


def value_slice(value: Column) -> Column:
    """Number of the slice, rising with the value; all values of zero or less share one."""
    value = as_double(value)
    place = F.floor(F.log2(value) * SLICES_PER_DOUBLING).cast("int")
    return F.when(value > 0, F.greatest(place, F.lit(-1000))).otherwise(F.lit(-1001))


def store_values(star: Star, path: str) -> None:
    """Order values in a folder for each slice, and the totals of each day."""
    values = order_values(star).select("order_id", "customer_id", "order_date", "order_value")
    values = values.withColumn("slice", value_slice(F.col("order_value")))
    # The rebalance writes few files a slice and splits one that holds too many rows.
    values.hint("rebalance", "slice").write.mode("overwrite").partitionBy("slice").parquet(f"{path}/values")
    # Folders of slices tell no schema where there is no order.
    values.limit(0).write.mode("overwrite").parquet(f"{path}/none")
    days = _stored_values(values.sparkSession, path).groupBy("order_date").agg(F.sum("order_value").alias("total"), F.count("order_value").alias("n"))
    days.write.mode("overwrite").parquet(f"{path}/days")


def _stored_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/none").schema).parquet(f"{path}/values")


def average_until(spark: SparkSession, path: str, day: dt.date) -> float | None:
    """Average value of the orders up to a day, from the totals of the days."""
    days = spark.read.parquet(f"{path}/days").filter(F.col("order_date") <= F.lit(day))
    return days.agg(as_double(F.sum("total")) / F.nullif(F.sum("n"), F.lit(0))).first()[0]


def changed_labels(spark: SparkSession, path: str, before: dt.date, after: dt.date) -> DataFrame:
    """Orders up to ``before`` whose label against the average differs between the two days."""
    old, new = average_until(spark, path, before), average_until(spark, path, after)
    values = _stored_values(spark, path).filter(F.col("order_date") <= F.lit(before))
    value = as_double(F.col("order_value"))
    if old is None or new is None:
        values, old, new = values.limit(0), 0.0, 0.0
    low, high = sorted((old, new))
    # The bounds are figures, so that folders outside of them are not even listed for reading.
    ends = spark.range(1).select(value_slice(F.lit(low)), value_slice(F.lit(high))).first()
    between = F.col("slice").between(*ends) & (value > F.lit(low)) & (value <= F.lit(high))
    rows = values.filter(between).select(
        "order_id",
        "customer_id",
        value.alias("order_value"),
        above_average(value, F.lit(old)).alias("label_before"),
        above_average(value, F.lit(new)).alias("label_after"),
    )
    return rows.orderBy("order_id")


def flag_changes(star: Star, before: dt.date, after: dt.date) -> DataFrame:
    """``changed_labels`` over freshly stored values."""
    spark = star.orders.sparkSession
    path = scratch_path(spark, "values")
    store_values(star, path)
    return changed_labels(spark, path, before, after)
