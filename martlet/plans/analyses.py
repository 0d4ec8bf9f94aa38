"""The analyses a report or dashboard asks for. Each returns a lazy, sorted DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.functions import (
    above_average,
    above_average_badge,
    as_double,
    currency_label,
    growth_direction,
    month_label,
    percent_label,
    rank_tier,
    signed_percent_label,
)
from martlet.operators import (
    group_share,
    mean_of,
    period_change,
    rank_by,
    running_total,
    share_of_total,
    top_n_per_group,
)
from martlet.plans.totals import (
    category_totals,
    customer_totals,
    monthly_sales,
    order_values,
    product_totals,
    seller_totals,
)
from martlet.sources.star import Star


def with_double(df: DataFrame, *columns: str) -> DataFrame:
    """Exact decimals leave the library as doubles."""
    return df.withColumns({c: as_double(F.col(c)) for c in columns})


# --- key figures ---------------------------------------------------------------


def kpi_summary(star: Star) -> DataFrame:
    """One row: total revenue, number of orders with lines, average order value."""
    totals = order_values(star).agg(
        as_double(F.sum("order_value")).alias("total_revenue"),
        F.count_distinct("order_id").alias("total_orders"),
    )
    average = F.col("total_revenue") / F.nullif(F.col("total_orders"), F.lit(0))
    return totals.withColumn("avg_order_value", average)


def best_month(star: Star) -> DataFrame:
    """The month with the largest sales; the earlier month wins a tie."""
    ordered = monthly_sales(star).orderBy(F.col("total_sales").desc_nulls_first(), "month")
    return with_double(ordered.limit(1), "total_sales")


def headline_cards(star: Star) -> DataFrame:
    """The key figures and the best month as display texts, one row."""
    best = best_month(star).select(
        F.struct(
            month_label(F.col("month")).alias("month"), currency_label(F.col("total_sales")).alias("sales")
        )
    )
    cards = kpi_summary(star).withColumn("best", best.scalar())
    return cards.select(
        currency_label(F.col("total_revenue")).alias("revenue_label"),
        F.format_number("total_orders", 0).alias("orders_label"),
        currency_label(F.col("avg_order_value")).alias("avg_order_label"),
        F.col("best.month").alias("best_month_label"),
        F.col("best.sales").alias("best_month_sales_label"),
    )


# --- sellers -------------------------------------------------------------------


def seller_rank(star: Star) -> DataFrame:
    """Sellers by sales, ties sharing a rank, with their share of the total."""
    shared = share_of_total(seller_totals(star), "total_sales", "pct_of_total")
    ranked = rank_by(
        shared,
        "total_sales",
        "sales_rank",
    )
    columns = ("seller_id", "seller_name", "total_sales", "sales_rank", "pct_of_total")
    return with_double(ranked, "total_sales").select(*columns).orderBy("sales_rank", "seller_id")


def seller_dense_rank(star: Star) -> DataFrame:
    """Sellers by sales without gaps after ties."""
    ranked = rank_by(
        seller_totals(star),
        "total_sales",
        "sales_rank",
        method="dense",
    )
    return with_double(ranked, "total_sales").orderBy("sales_rank", "seller_id")


def seller_tiers(star: Star) -> DataFrame:
    """The ranking table with a tier per seller and display texts."""
    return seller_rank(star).select(
        "*",
        rank_tier(F.col("sales_rank")).alias("tier"),
        F.concat(F.lit("#"), F.col("sales_rank").cast("string")).alias("rank_label"),
        currency_label(F.col("total_sales")).alias("sales_label"),
        percent_label(F.col("pct_of_total")).alias("share_label"),
    )


# --- months --------------------------------------------------------------------


def complete_months(monthly: DataFrame, star: Star) -> DataFrame:
    """Drop the last month unless the orders reach its last day."""
    last = star.orders.agg(F.max("order_date")).scalar()
    return monthly.filter(F.col("month").isNull() | (F.last_day("month") <= last))


def _months(star: Star, complete_periods_only: bool) -> DataFrame:
    monthly = monthly_sales(star)
    return complete_months(monthly, star) if complete_periods_only else monthly


def monthly_running_total(star: Star) -> DataFrame:
    """Sales per month and their running total."""
    running = running_total(monthly_sales(star), "month", "total_sales", short_series=True)
    return with_double(running, "total_sales", "running_total").orderBy(F.col("month").asc_nulls_last())


def mom_growth(star: Star, *, calendar: bool = False, complete_periods_only: bool = False) -> DataFrame:
    """Growth over the previous month; NULL unless that month's sales are above zero."""
    months = _months(star, complete_periods_only)
    growth = period_change(months, ["month"], "total_sales", guard="positive", calendar=calendar)
    return with_double(growth, "total_sales").orderBy(F.col("month").asc_nulls_last())


def mom_growth_ym(star: Star) -> DataFrame:
    """Growth by year and month number; NULL only where the previous sales are zero or absent."""
    months = (
        order_values(star)
        .groupBy(
            F.year("order_date").cast("bigint").alias("year"),
            F.month("order_date").cast("bigint").alias("month"),
        )
        .agg(F.sum("order_value").alias("total_sales"))
    )
    growth = period_change(months, ["year", "month"], "total_sales", guard="nonzero")
    keys = [F.col(c).asc_nulls_last() for c in ("year", "month")]
    return growth.select("year", "month", "growth_rate").orderBy(*keys)


def next_month_delta(star: Star) -> DataFrame:
    """Sales of the following month and the difference to it."""
    following = F.lead("total_sales", 1).over(W.orderBy(F.col("month").asc_nulls_last()))
    months = monthly_sales(star).withColumn("next_sales", following)
    months = months.withColumn("delta", F.col("next_sales") - F.col("total_sales"))
    return with_double(months, "total_sales", "next_sales", "delta").orderBy(F.col("month").asc_nulls_last())


def growth_direction_by_month(star: Star) -> DataFrame:
    """Months that have a growth rate, marked up or down."""
    growth = mom_growth(star).na.drop(subset=["growth_rate"])
    return growth.withColumn("direction", growth_direction(F.col("growth_rate")))


def growth_extremes(star: Star) -> DataFrame:
    """Strongest growth and largest decline; NULLs if no month has a growth rate.
    The earlier month wins a tie."""
    growth = period_change(monthly_sales(star), ["month"], "total_sales").filter(
        F.col("growth_rate").isNotNull()
    )
    # Days back from the last date of the calendar: larger means earlier.
    earliness = F.date_diff(F.lit("9999-12-31").cast("date"), F.col("month"))
    best = F.max_by("month", F.struct(F.col("growth_rate"), earliness))
    worst = F.min_by("month", F.struct(F.col("growth_rate"), -earliness))
    figures = growth.agg(
        best.alias("best_month"),
        F.max("growth_rate").alias("best_growth"),
        worst.alias("worst_month"),
        F.min("growth_rate").alias("worst_growth"),
    )
    return figures.select(
        "*",
        month_label(F.col("best_month")).alias("best_month_label"),
        signed_percent_label(F.col("best_growth")).alias("best_growth_label"),
        month_label(F.col("worst_month")).alias("worst_month_label"),
        signed_percent_label(F.col("worst_growth")).alias("worst_growth_label"),
    )


def growth_table(star: Star, up: int = 5, down: int = 3) -> DataFrame:
    """The ``up`` months that grew most and the ``down`` that fell most; the earlier month wins a tie."""
    growth = period_change(monthly_sales(star), ["month"], "total_sales").filter(
        F.col("growth_rate").isNotNull()
    )
    ends = [
        growth.filter(sign)
        .orderBy(order, "month")
        .limit(n)
        .select(F.lit(name).alias("direction"), "month", "growth_rate", F.row_number().over(W.orderBy(order, "month")).cast("bigint").alias("place"))
        for name, sign, order, n in (
            ("up", F.col("growth_rate") > 0, F.desc("growth_rate"), up),
            ("down", F.col("growth_rate") < 0, F.asc("growth_rate"), down),
        )
    ]
    return ends[0].unionByName(ends[1])


# --- customers -----------------------------------------------------------------


def flagged_orders(star: Star) -> DataFrame:
    """Orders with their exact value, labelled against the average over all orders."""
    values = order_values(star).select("customer_id", "order_id", "order_value")
    # By way of customers, the average needs the columns that the orders need, so both read one shuffle.
    totals = values.groupBy("customer_id").agg(F.sum("order_value").alias("total"), F.count("*").alias("n"))
    average = totals.agg(mean_of("total", F.sum("n"))).scalar()
    return values.withColumn("value_category", above_average(as_double(F.col("order_value")), average))


def order_value_flag(star: Star, sort: bool = True) -> DataFrame:
    """Every order with its value and label, largest first. ``sort=False`` saves the
    global sort when the result is only written to a table."""
    flagged = flagged_orders(star)
    if sort:
        flagged = flagged.orderBy(F.col("order_value").desc_nulls_first(), "order_id")
    return with_double(flagged, "order_value")


def _segments(star: Star) -> DataFrame:
    totals = customer_totals(star)
    # Mean over orders, not over customers: totals and counts are added first.
    threshold = totals.agg(mean_of("total_spent", F.sum("order_count"))).scalar()
    own = as_double(F.col("total_spent")) / F.col("order_count")
    return totals.withColumn("avg_order_value", own).withColumn(
        "value_category", above_average(F.col("avg_order_value"), threshold)
    )


def _by_spending(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("total_spent").desc_nulls_first(), "customer_id")


def customer_segments(star: Star, sort: bool = True) -> DataFrame:
    """Customers by spending; the label compares the customer's average order with
    the average over all orders."""
    segments = _segments(star)
    return with_double(_by_spending(segments) if sort else segments, "total_spent")


def top_customers(star: Star, n: int = 15) -> DataFrame:
    """The ``n`` customers who spent most, with a badge for their segment."""
    top = _by_spending(_segments(star)).limit(n)
    badge = above_average_badge(F.col("value_category"))
    return with_double(top.withColumn("badge", badge), "total_spent")


# --- categories and products ---------------------------------------------------


def category_share(star: Star, price: str = "charged") -> DataFrame:
    """Sales per category and their share of all categories' sales."""
    shares = share_of_total(category_totals(star, price), "total_sales", "sales_pct")
    ordered = shares.orderBy(F.col("sales_pct").desc_nulls_first(), "category_id")
    return with_double(ordered, "total_sales")


def top_products(star: Star, n: int = 3, price: str = "charged") -> DataFrame:
    """The ``n`` best-selling products of each category, keyed by category id.

    Category names join the few rows that are left.
    """
    named = product_totals(star, price).filter(F.col("category_id").isNotNull())
    top = top_n_per_group(named, "category_id", "total_sales", "product_id", n)
    rows = top.join(star.categories.select("category_id", "category_name"), "category_id")
    return with_double(
        rows.select("category_id", "category_name", "product_id", "product_name", "total_sales", "rn"),
        "total_sales",
    ).orderBy("category_id", "rn")


def top_products_by_id(star: Star, n: int = 3, price: str = "charged") -> DataFrame:
    """The same without the category table: products without a category form a group."""
    top = top_n_per_group(product_totals(star, price), "category_id", "total_sales", "product_id", n)
    rows = top.select("category_id", "product_id", "product_name", "total_sales", "rn")
    return with_double(rows, "total_sales").orderBy(F.col("category_id").asc_nulls_last(), "rn")


def category_top_total(star: Star, n: int = 3) -> DataFrame:
    """Categories ordered by the sum of their shown (top ``n``) products."""
    named = product_totals(star).filter(F.col("category_id").isNotNull())
    top = top_n_per_group(named, "category_id", "total_sales", "product_id", n)
    sums = top.groupBy("category_id").agg(F.sum("total_sales").alias("shown_total"))
    rows = sums.join(star.categories.select("category_id", "category_name"), "category_id")
    return with_double(
        rows.orderBy(F.col("shown_total").asc_nulls_last(), "category_id"), "shown_total"
    ).select("category_id", "category_name", "shown_total")


def product_share_in_category(star: Star) -> DataFrame:
    """Each product's share of its category's sales."""
    shares = group_share(product_totals(star), "category_id", "total_sales", "pct_of_category")
    rows = shares.select("category_id", "product_id", "product_name", "total_sales", "pct_of_category")
    return with_double(rows, "total_sales")


# --- exploration ---------------------------------------------------------------


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy("tbl")


def order_seller_detail(star: Star, limit: int | None = None) -> DataFrame:
    """Who sold each order; several rows if an order's lines have several sellers."""
    if star.seller_on_lines:
        pairs = star.lines.select("order_id", "seller_id").distinct()
        rows = star.orders.join(pairs, "order_id")
    else:
        rows = star.orders
    rows = rows.join(star.sellers.select("seller_id", "seller_name"), "seller_id")
    rows = rows.select("seller_name", "order_id", "order_date")
    return rows if limit is None else rows.orderBy("order_id", "seller_name").limit(limit)


def order_customer_detail(star: Star, limit: int | None = None) -> DataFrame:
    """Who bought each order."""
    names = [c for c in ("customer_name", "contact_name") if c in star.customers.columns]
    rows = star.orders.join(star.customers, "customer_id").select("order_id", *names, "order_date")
    return rows if limit is None else rows.orderBy("order_id").limit(limit)


def line_product_detail(star: Star, limit: int | None = None) -> DataFrame:
    """Product, quantity and date of each order line."""
    rows = (
        star.lines.select("order_id", "product_id", "quantity")
        .join(star.products.select("product_id", "product_name"), "product_id")
        .join(star.orders.select("order_id", "order_date"), "order_id")
        .select("order_id", "product_name", "quantity", "order_date")
    )
    return rows if limit is None else rows.orderBy("order_id", "product_name", "quantity").limit(limit)
