"""Numbers of distinct orders that roll up without reading the lines again.

Orders with a product of a category are kept as bitmaps per month and category. A
bitmap that covers a longer period or all categories is the OR of others, so a count
at any level is exact although an order may have products of several categories.

Bits stand for numbers that orders get in order of (month, id): the orders of a month
lie in few buckets of 32,768 bits, and their bitmaps are dense however large or
scattered the ids are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.session import materialise
from martlet.sources.star import Star

PERIODS = ("month", "quarter", "year")


def numbered_orders(star: Star) -> DataFrame:
    """``order_id``, ``month`` and ``number``, counted from 0 in order of month and id.

    Sorted ranges are written once; a row's number is its place in its range plus the
    rows of the ranges before, of which there is one figure per range.
    """
    spark = star.orders.sparkSession
    months = star.orders.select("order_id", F.trunc("order_date", "month").alias("month"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = months.repartitionByRange(parts, "month", "order_id").sortWithinPartitions("month", "order_id")
    places = {"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
    ordered = materialise(ordered.withColumns(places), "ordered")
    counts = ordered.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    number = F.col("_before") + F.col("_at") - F.col("_first")
    return ordered.join(counts, "_range").select("order_id", "month", number.alias("number"))


def order_bitmaps(star: Star) -> DataFrame:
    """``month``, ``category_id``, ``bucket`` and ``bits`` of the orders that have lines."""
    sold = star.lines.select("order_id", "product_id").join(
        star.products.select("product_id", "category_id"), "product_id"
    )
    known = sold.join(numbered_orders(star), "order_id")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    return materialise(
        known.groupBy("month", "category_id", F.bitmap_bucket_number("number").alias("bucket")).agg(bits), "bitmaps"
    )


def merged(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Bitmaps of the coarser groups that ``keys`` name."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Orders per group: the bits of its buckets added up."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("order_count"))


def distinct_orders(bitmaps: DataFrame) -> DataFrame:
    """Orders per month, quarter and year, for each category and for all (NULL), each from the level below."""
    parts, level = [], bitmaps.withColumnRenamed("month", "period")
    for period in PERIODS:
        if period != "month":
            level = merged(level.withColumn("period", F.trunc("period", period)), "period", "category_id")
        label = F.lit(period).alias("level")
        by_category = counted(level, "period", "category_id")
        together = counted(merged(level, "period"), "period")
        parts.append(by_category.select(label, "period", F.col("category_id").cast("string").alias("category"), "order_count"))
        parts.append(together.select(label, "period", F.lit(None).cast("string").alias("category"), "order_count"))
    return reduce(DataFrame.unionByName, parts)


def distinct_orders_rollup(star: Star) -> DataFrame:
    return distinct_orders(order_bitmaps(star))
