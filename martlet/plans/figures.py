"""Figures that management reports quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.functions import as_double, percent_of
from martlet.functions.labels import ABOVE
from martlet.operators import (
    mean_of,
    ordered_prefix,
    running_total,
    same_period_before,
    top_n_per_group,
)
from martlet.operators.growth import change_rate
from martlet.plans.analyses import category_share, flagged_orders, top_products, with_double
from martlet.plans.totals import (
    category_totals,
    customer_totals,
    monthly_sales,
    order_values,
    product_totals,
    seller_totals,
)
from martlet.session import materialise
from martlet.sources.star import Star


def topk_share(star: Star, k: int = 5) -> DataFrame:
    """Share of the total that the sellers ranked 1 to ``k`` make.

    Ties are collapsed first, so ``k`` distinct totals are enough to find them all.
    """
    totals = seller_totals(star)
    ties = totals.filter(F.col("total_sales").isNotNull()).groupBy("total_sales").agg(F.count("*").alias("n"))
    leading = ties.orderBy(F.desc("total_sales")).limit(k)
    ahead = W.orderBy(F.desc("total_sales")).rowsBetween(W.unboundedPreceding, -1)
    ranked = leading.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    tied_sum = F.col("total_sales") * F.col("n").cast("decimal(10,0)")
    top = ranked.filter(F.col("ahead") < k).agg(F.sum(tied_sum).alias("top_sales"))
    rows = top.withColumn("total_sales", totals.agg(F.sum("total_sales")).scalar())
    share = percent_of(F.col("top_sales"), F.col("total_sales"))
    return with_double(rows.withColumn("top_share_pct", share), "top_sales", "total_sales")


def leader_ratio(star: Star) -> DataFrame:
    """Best seller's sales over the weakest seller's."""
    ends = seller_totals(star).agg(
        as_double(F.max("total_sales")).alias("best_sales"),
        as_double(F.min("total_sales")).alias("worst_sales"),
    )
    return ends.withColumn("ratio", F.col("best_sales") / F.nullif(F.col("worst_sales"), F.lit(0.0)))


def category_pareto(star: Star) -> DataFrame:
    """Categories from largest to smallest with their cumulative share."""
    totals = category_totals(star)
    rows = running_total(
        totals,
        "total_sales",
        "total_sales",
        "cumulative",
        descending=True,
    )
    total = totals.agg(F.sum("total_sales")).scalar()
    rows = rows.withColumn("cumulative_pct", percent_of(F.col("cumulative"), total))
    ordered = rows.orderBy(F.col("total_sales").desc_nulls_first(), "category_id")
    return with_double(ordered.drop("cumulative"), "total_sales").select(
        "category_id", "category_name", "total_sales", "cumulative_pct"
    )


def small_categories(star: Star, threshold: float = 8.0) -> DataFrame:
    """Categories whose share is below ``threshold`` percent."""
    return category_share(star).filter(F.col("sales_pct") < threshold)


def max_order_ratio(star: Star) -> DataFrame:
    """Largest order over the average order."""
    figures = order_values(star).agg(
        as_double(F.max("order_value")).alias("max_order"), mean_of("order_value").alias("avg_order")
    )
    return figures.withColumn("ratio", F.col("max_order") / F.nullif(F.col("avg_order"), F.lit(0.0)))


def repeat_high_value(star: Star, at_least: int = 2) -> DataFrame:
    """Customers with several above-average orders."""
    high = flagged_orders(star).filter(F.col("value_category") == ABOVE)
    counts = high.groupBy("customer_id").agg(
        F.count("*").alias("high_value_orders"), F.sum("order_value").alias("high_value_total")
    )
    rows = counts.filter(F.col("high_value_orders") >= at_least)
    ordered = rows.orderBy(F.desc("high_value_orders"), F.col("customer_id").asc_nulls_last())
    return with_double(ordered, "high_value_total")


def product_beats_category(star: Star) -> DataFrame:
    """Best product of each category and how many other categories it outsells.

    Product and category totals are sorted together; the categories before a
    product are those it exceeds, so no pairs are formed. Product totals are written
    first, so that the lines are read once.
    """
    if "product_totals_charged" not in star.shared:
        star = star.with_shared(product_totals_charged=materialise(product_totals(star), "product-totals"))
    categories = category_totals(star)
    named = product_totals(star).filter(F.col("category_id").isNotNull())
    best = top_n_per_group(named, "category_id", "total_sales", "product_id", 1).join(
        categories.select("category_id", "category_name", F.col("total_sales").alias("own")), "category_id"
    )
    points = best.select("*", F.lit(0).alias("is_category")).unionByName(
        categories.select("total_sales", F.lit(1).alias("is_category")), allowMissingColumns=True
    )
    sums = ordered_prefix(points, "total_sales", "is_category")
    own_below = F.when(F.col("own") < F.col("total_sales"), 1).otherwise(0)
    beaten = F.col("_upto") - F.col("_tied") - own_below
    rows = sums.filter(F.col("is_category") == 0).select(
        "category_id",
        "category_name",
        "product_id",
        "product_name",
        as_double(F.col("total_sales")).alias("total_sales"),
        beaten.cast("bigint").alias("categories_beaten"),
    )
    return rows.orderBy("category_id")


def top_orders(star: Star, n: int = 5) -> DataFrame:
    """The ``n`` largest orders with their label."""
    top = flagged_orders(star).orderBy(F.col("order_value").desc_nulls_first(), "order_id").limit(n)
    return with_double(top, "order_value")


def top_product_per_category(star: Star) -> DataFrame:
    return top_products(star, n=1)


def repeat_customers(star: Star) -> DataFrame:
    """Customers with more than one order."""
    rows = customer_totals(star).filter(F.col("order_count") > 1)
    return rows.select("customer_id", "customer_name", "order_count").orderBy(
        F.desc("order_count"), "customer_id"
    )


def yoy_growth(star: Star) -> DataFrame:
    """Growth over the same month of the year before; NULL where that month is absent."""
    months = monthly_sales(star).filter(F.col("month").isNotNull())
    rows = months.withColumn("year_ago_sales", same_period_before("total_sales", "month", 12))
    growth = change_rate(F.col("total_sales"), F.col("year_ago_sales"), "positive")
    return with_double(rows.withColumn("yoy_pct", growth), "total_sales", "year_ago_sales").orderBy("month")
