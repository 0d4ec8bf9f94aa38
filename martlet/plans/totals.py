"""Totals the analyses share.

Every total is aggregated on the fact's own key before it meets a dimension. The
map-side sum turns a key that holds a third of all lines into one row per task,
the shuffle carries totals instead of lines, and both join sides then have unique
keys. Dimension joins carry no broadcast hint: whether a side is small enough is
decided by its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.functions import exact_sum
from martlet.functions.measures import MONEY
from martlet.session import materialise
from martlet.sources.star import Star

PRICES = ("charged", "list")


def order_values(star: Star) -> DataFrame:
    """Orders that have lines, with the order's net revenue as an exact decimal.

    Lines group and join on the same key, so each side is shuffled once.
    """
    if "order_values" in star.shared:
        return star.shared["order_values"]
    per_order = star.lines.groupBy("order_id").agg(exact_sum("net").alias("order_value"))
    return star.orders.join(per_order, "order_id")


def monthly_sales(star: Star) -> DataFrame:
    """``month`` (first day) and exact ``total_sales``; orders without a date share a NULL month."""
    if "monthly_sales" in star.shared:
        return star.shared["monthly_sales"]
    return (
        order_values(star)
        .groupBy(F.trunc("order_date", "month").alias("month"))
        .agg(F.sum("order_value").alias("total_sales"))
    )


def seller_totals(star: Star) -> DataFrame:
    """``seller_id``, ``seller_name`` and exact ``total_sales`` over lines of known orders."""
    if "seller_sums" in star.shared:
        per_seller = star.shared["seller_sums"]
    elif star.seller_on_lines:
        lines = star.lines
        if not star.orders_checked:
            lines = lines.join(star.orders.select("order_id"), "order_id", "left_semi")
        per_seller = lines.groupBy("seller_id").agg(exact_sum("net").alias("total_sales"))
    else:
        per_seller = order_values(star).groupBy("seller_id").agg(F.sum("order_value").alias("total_sales"))
    named = per_seller.join(star.sellers.select("seller_id", "seller_name"), "seller_id")
    return named.select("seller_id", "seller_name", "total_sales")


def product_totals(star: Star, price: str = "charged") -> DataFrame:
    """``product_id``, ``product_name``, ``category_id`` and exact ``total_sales``.

    ``price`` is ``charged`` (the price on the line) or ``list`` (today's price of
    the product). A product has one list price, so its discounted quantities are
    summed first and priced once.
    """
    if price not in PRICES:
        raise ValueError(f"unknown price {price!r}")
    shared = f"product_totals_{price}"
    if shared in star.shared:
        return star.shared[shared]
    products = star.products.select("product_id", "product_name", "category_id", "list_price")
    if price == "charged":
        per_product = star.lines.groupBy("product_id").agg(exact_sum("net").alias("total_sales"))
        named = per_product.join(products, "product_id")
        return named.select("product_id", "product_name", "category_id", "total_sales")
    kept = exact_sum("quantity * (1 - discount)").cast("decimal(20,8)")
    per_product = star.lines.groupBy("product_id").agg(kept.alias("kept"))
    return per_product.join(products, "product_id").select(
        "product_id",
        "product_name",
        "category_id",
        (F.col("kept") * F.col("list_price").cast("decimal(18,8)")).cast("decimal(28,8)").alias("total_sales"),
    )


def category_totals(star: Star, price: str = "charged") -> DataFrame:
    """``category_id``, ``category_name`` and exact ``total_sales``; products without
    a category drop out."""
    per_category = (
        product_totals(star, price).groupBy("category_id").agg(F.sum("total_sales").alias("total_sales"))
    )
    named = per_category.join(star.categories.select("category_id", "category_name"), "category_id")
    return named.select("category_id", "category_name", "total_sales")


def customer_totals(star: Star) -> DataFrame:
    """``customer_id``, ``customer_name``, ``order_count`` and exact ``total_spent``."""
    per_customer = (
        order_values(star)
        .groupBy("customer_id")
        .agg(F.count("*").alias("order_count"), F.sum("order_value").alias("total_spent"))
    )
    named = per_customer.join(star.customers.select("customer_id", "customer_name"), "customer_id")
    return named.select("customer_id", "customer_name", "order_count", "total_spent")


def line_sums(star: Star) -> DataFrame:
    """Exact sums of the lines by order and by product, out of one scan and one exchange.

    ``of_order`` is 1 for rows by order (and seller, where the lines carry one) and 0
    for rows by product; the keys of the other kind are NULL.
    """
    of_order = ["order_id", "seller_id"] if star.seller_on_lines else ["order_id"]
    sets = star.lines.groupingSets([of_order, ["product_id"]], *of_order, "product_id")
    return sets.agg(F.grouping("product_id").cast("int").alias("of_order"), exact_sum("net").alias("net"))


def share_totals(star: Star) -> Star:
    """The star with all totals that analyses start from written to the scratch folder.

    The lines are read once: sums by order, seller and product come from one pass with
    grouping sets, and what is left works on these. Orders and sellers are told apart
    in one more pass over the sums, after orders that do not exist have dropped out.
    A lost executor repeats neither.
    """
    sums = materialise(line_sums(star), "line-sums")
    by_order = sums.filter("of_order = 1").drop("product_id", "of_order")
    known = by_order.join(star.orders, "order_id")
    columns = star.orders.columns
    if star.seller_on_lines:
        sets = known.groupingSets([columns, ["seller_id"]], *columns, "seller_id")
        both = materialise(
            sets.agg(F.grouping("seller_id").cast("int").alias("of_order"), F.sum("net").cast(MONEY).alias("net")), "order-sums"
        )
        values = both.filter("of_order = 1").select(*columns, F.col("net").alias("order_value"))
        sellers = both.filter("of_order = 0").select("seller_id", F.col("net").alias("total_sales"))
    else:
        values = materialise(known.select(*columns, F.col("net").alias("order_value")), "order-values")
        sellers = materialise(values.groupBy("seller_id").agg(F.sum("order_value").alias("total_sales")), "seller-sums")
    products = star.products.select("product_id", "product_name", "category_id")
    by_product = sums.filter("of_order = 0").select("product_id", F.col("net").alias("total_sales"))
    by_product = by_product.join(products, "product_id")
    shared = star.with_shared(
        order_values=values,
        seller_sums=sellers,
        product_totals_charged=materialise(
            by_product.select("product_id", "product_name", "category_id", "total_sales"), "product-totals"
        ),
    )
    return shared.with_shared(monthly_sales=materialise(monthly_sales(shared), "monthly-sales"))
