"""The dimensional model: date, product, customer, seller, category and shipper
dimensions, the sales fact at line grain, and roll-ups of its additive measures."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from martlet.functions import as_double, exact_sum, money
from martlet.functions.measures import SCALE
from martlet.sources.star import Star


def dim_date(star: Star) -> DataFrame:
    """Every calendar day from the first to the last order. Weeks start on Sunday = 0."""
    span = star.orders.agg(F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    days = span.filter(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last")).alias("full_date")
    )
    day = F.col("full_date")
    return days.select(
        day,
        F.month(day).cast("bigint").alias("month"),
        F.quarter(day).cast("bigint").alias("quarter"),
        F.year(day).cast("bigint").alias("year"),
        (F.dayofweek(day) - 1).cast("bigint").alias("day_of_week"),
    )


def _attributes(df: DataFrame, *columns: str) -> DataFrame:
    """The listed columns that the source has."""
    return df.select(*[c for c in columns if c in df.columns])


def dim_product(star: Star) -> DataFrame:
    """Products with their category's name; products without a category keep NULL."""
    names = star.categories.select("category_id", "category_name")
    return _attributes(
        star.products.join(names, "category_id", "left"),
        "product_id",
        "product_name",
        "category_id",
        "category_name",
        "list_price",
        "discontinued",
        "brand",
    )


def dim_customer(star: Star) -> DataFrame:
    """Customers with their place."""
    customers = star.customers
    if star.has("places"):
        customers = customers.join(star.places, "place_id", "left")
    return _attributes(
        customers,
        "customer_id",
        "customer_name",
        "contact_name",
        "city",
        "country",
        "nation",
        "region",
        "segment",
    )


def dim_seller(star: Star) -> DataFrame:
    return _attributes(
        star.sellers, "seller_id", "seller_name", "first_name", "last_name", "title", "hire_date"
    )


def dim_category(star: Star) -> DataFrame:
    return _attributes(star.categories, "category_id", "category_name", "description")


def dim_shipper(star: Star) -> DataFrame:
    if not star.has("shippers"):
        raise ValueError("the source has no shippers")
    return star.shippers.select("shipper_id", "shipper_name")


def fact_sales(star: Star) -> DataFrame:
    """One row per order line whose order exists, with all keys and measures.

    A plain equi-join on the order key: bucketed inputs need no exchange, and an
    order that holds too many lines is split by the adaptive skew join.
    """
    seller = star.lines["seller_id"] if star.seller_on_lines else star.orders["seller_id"]
    return star.lines.join(star.orders, star.lines["order_id"] == star.orders["order_id"]).select(
        star.lines["order_id"],
        "product_id",
        "customer_id",
        seller,
        "order_date",
        "quantity",
        "unit_price",
        "discount",
        as_double(money(F.col("gross"))).alias("gross_revenue"),
        as_double(money(F.col("net"))).alias("net_revenue"),
    )


# Date attribute -> its expression over the order date.
_DATES = {
    "order_date": "order_date",
    "month": "trunc(order_date, 'month')",
    "quarter": "CAST(quarter(order_date) AS BIGINT)",
    "year": "CAST(year(order_date) AS BIGINT)",
    "day_of_week": "CAST(dayofweek(order_date) - 1 AS BIGINT)",
}
# Other attribute -> the dimension key that leads to it.
_DIMENSION_KEYS = {
    "customer_id": "customer_id",
    "customer_name": "customer_id",
    "contact_name": "customer_id",
    "city": "customer_id",
    "country": "customer_id",
    "nation": "customer_id",
    "region": "customer_id",
    "segment": "customer_id",
    "product_id": "product_id",
    "product_name": "product_id",
    "brand": "product_id",
    "category_id": "product_id",
    "category_name": "product_id",
    "list_price": "product_id",
    "discontinued": "product_id",
    "supplier_id": "product_id",
    "supplier_name": "product_id",
    "seller_id": "seller_id",
    "seller_name": "seller_id",
    "title": "seller_id",
    "hire_date": "seller_id",
    "shipper_id": "shipper_id",
    "shipper_name": "shipper_id",
}
# Attribute that a dimension only has the key of -> that key, and the table that is joined on it.
_OUTER = {
    "nation": ("place_id", "places"),
    "region": ("place_id", "places"),
    "category_name": ("category_id", "categories"),
    "supplier_name": ("supplier_id", "suppliers"),
    "shipper_name": ("shipper_id", "shippers"),
}
# Dimension key -> the table that must have it.
_DIMENSIONS = {"customer_id": "customers", "product_id": "products", "seller_id": "sellers"}
# Attributes of the seller's territories, of which there may be several.
_SEVERAL = ("territory_id", "territory", "sales_region")
_ADDITIVE = ("line_count", "quantity", "gross_revenue", "net_revenue")


def _summed_lines(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("line_count"),
        exact_sum("quantity").alias("quantity"),
        exact_sum("gross").alias("gross_revenue"),
        exact_sum("net").alias("net_revenue"),
    )


def _added(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _ADDITIVE])


def _checked(star: Star, by: tuple[str, ...]) -> None:
    unknown = [a for a in by if a not in _DATES and a not in _DIMENSION_KEYS and a not in _SEVERAL]
    if unknown or not by:
        known = sorted([*_DATES, *_DIMENSION_KEYS, *_SEVERAL])
        raise ValueError(f"unknown attributes {unknown}; known are {known}")
    if set(by) & set(_SEVERAL) and not star.has("territories"):
        raise ValueError("the source has no territories")


def _summed_on_key(star: Star, by: tuple[str, ...], dates: list[str], dimensions: list[str]) -> DataFrame:
    """Measures by one date attribute or dimension key, or by several as asked for, with the dimensions' attributes."""
    keys = dates + dimensions
    order_keys = [k for k in dimensions if k not in star.lines.columns]
    orders = star.orders.selectExpr("order_id", *order_keys, *[f"{_DATES[d]} AS {d}" for d in dates])
    if set(dimensions) == set(order_keys):
        # Only order attributes: an order's lines become one row before the join.
        rows = _added(_summed_lines(star.lines, ["order_id"]).join(orders, "order_id"), keys)
    elif star.orders_checked and not dates and not order_keys:
        rows = _summed_lines(star.lines, keys)
    else:
        rows = _summed_lines(star.lines.join(orders, "order_id"), keys)

    if "customer_id" in dimensions:
        customers = star.customers
        if star.has("places") and {"nation", "region"} & set(by):
            customers = customers.join(star.places, "place_id")
        rows = rows.join(customers, "customer_id")
    if "product_id" in dimensions:
        products = star.products
        if "category_name" in by:
            products = products.join(star.categories, "category_id")
        if "supplier_name" in by:
            products = products.join(star.suppliers, "supplier_id")
        rows = rows.join(products, "product_id")
    if "shipper_id" in dimensions:
        rows = rows.join(star.shippers, "shipper_id") if "shipper_name" in by else rows
    if "seller_id" in dimensions:
        rows = rows.join(star.sellers, "seller_id")
    return rows


def _summed_on_attributes(
    star: Star, plain: list[str], dates: list[str], dimensions: list[str], by_seller: bool
) -> DataFrame:
    """Measures by several attributes, and by seller too if asked for.

    Customers, and whatever else an order leads to, are joined to the orders, so that
    lines move once to meet them, and once for each dimension that is recorded per line.
    Names that a dimension only has the key of are joined to the sums.
    """
    columns = {k: [] for k in dimensions}
    for a in plain:
        if a in _DIMENSION_KEYS:
            columns[_DIMENSION_KEYS[a]].append(_OUTER[a][0] if a in _OUTER else a)
    if by_seller:
        columns["seller_id"].append("seller_id")

    def attached(rows: DataFrame, keys: list[str]) -> DataFrame:
        for key in keys:
            if key in _DIMENSIONS:
                own = dict.fromkeys([key, *columns[key]])
                rows = rows.join(getattr(star, _DIMENSIONS[key]).select(*own), key)
        return rows

    order_keys = [k for k in dimensions if k not in star.lines.columns]
    line_keys = [k for k in dimensions if k in star.lines.columns]
    orders = star.orders.selectExpr("order_id", *order_keys, *[f"{_DATES[d]} AS {d}" for d in dates])
    orders = attached(orders, order_keys)
    on = list(dict.fromkeys([*dates, *(c for own in columns.values() for c in own)]))
    if line_keys:
        needless = star.orders_checked and not dates and not order_keys
        lines = star.lines if needless else star.lines.join(orders, "order_id")
        rows = _summed_lines(attached(lines, line_keys), on)
    else:
        rows = _added(_summed_lines(star.lines, ["order_id"]).join(orders, "order_id"), on)
    for key, table in dict.fromkeys(_OUTER[a] for a in plain if a in _OUTER):
        rows = rows.join(getattr(star, table), key)
    return rows


def exact_measures(star: Star, *by: str) -> DataFrame:
    """Additive measures by any attributes of the dimensions, as exact decimals.

    Only the dimensions in use are joined. By a single dimension the lines are summed on
    its key before the join. Several keys, or a date and a key, tell nearly all lines
    apart, so that sums by them would be as many and wider: there the attributes are
    joined first. Attributes of territories go through the bridge: see ``_allocated``.
    """
    _checked(star, by)
    plain = [a for a in by if a not in _SEVERAL]
    several = [a for a in by if a in _SEVERAL]
    dates = [a for a in plain if a in _DATES]
    dimensions = {_DIMENSION_KEYS[a] for a in plain if a in _DIMENSION_KEYS}
    dimensions = sorted(dimensions | {"seller_id"} if several else dimensions)
    keys = dates + dimensions

    if len(keys) > 1 and keys != list(by):
        rows = _summed_on_attributes(star, plain, dates, dimensions, bool(several))
    else:
        rows = _summed_on_key(star, by, dates, dimensions)
    if several:
        rows = _allocated(_added(rows, list(dict.fromkeys([*plain, "seller_id"]))), star)
    if several or keys != list(by):
        rows = _added(rows, list(by))
    return rows.select(*by, *_ADDITIVE)


def territory_bridge(star: Star) -> DataFrame:
    """One row per seller and territory, with the number of the territory and how many the seller has."""
    territories = star.territories.select("seller_id", *_SEVERAL).distinct()
    own = W.partitionBy("seller_id")
    return territories.withColumns(
        {"nth": F.row_number().over(own.orderBy("territory_id")), "territories": F.count("*").over(own)}
    )


def _allocated(rows: DataFrame, star: Star) -> DataFrame:
    """Rows by seller, dealt to the seller's territories.

    Each of n territories gets an n-th of the smallest units of a measure, and the
    first ones one unit more until nothing is left, so that the parts add up to the
    whole exactly however often a seller occurs in the bridge. Sellers without a
    territory keep their measures under NULL.
    """
    joined = rows.join(territory_bridge(star), "seller_id", "left")
    n = F.coalesce("territories", F.lit(1)).cast("decimal(10,0)")
    nth = F.coalesce("nth", F.lit(1))

    def part(measure: str) -> Column:
        scale = 0 if measure == "line_count" else SCALE
        units = (F.col(measure).cast(f"decimal(28,{scale})") * F.lit(Decimal(10**scale))).cast("decimal(38,0)")
        rest = F.pmod(units, n)
        whole = ((units - rest) / n).cast("decimal(28,0)")
        dealt = whole + F.when(nth <= rest, 1).otherwise(0)
        if not scale:
            return dealt.cast("bigint")
        return (dealt.cast("decimal(28,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(28,{scale})")

    return joined.withColumns({m: part(m) for m in _ADDITIVE})


def as_report(measures: DataFrame, *by: str) -> DataFrame:
    """Exact measures as doubles, sorted by the attributes."""
    return measures.select(
        *by, "line_count", *[as_double(F.col(c)).alias(c) for c in _ADDITIVE[1:]]
    ).orderBy(*[F.col(c).asc_nulls_last() for c in by])


def revenue_by(star: Star, *by: str) -> DataFrame:
    """Additive measures rolled up by any attributes of the dimensions."""
    return as_report(exact_measures(star, *by), *by)


def avg_price_discount(star: Star) -> DataFrame:
    """Average unit price and discount per category: rates are averaged, never added up."""
    per_product = star.lines.groupBy("product_id").agg(
        exact_sum("unit_price", 8).alias("price"),
        F.count("unit_price").alias("prices"),
        exact_sum("discount", 8).alias("discount"),
        F.count("discount").alias("discounts"),
    )
    rows = per_product.join(star.products.select("product_id", "category_id"), "product_id")
    sums = rows.groupBy("category_id").agg(
        *[F.sum(c).alias(c) for c in ("price", "prices", "discount", "discounts")]
    )
    named = sums.join(star.categories.select("category_id", "category_name"), "category_id")
    return named.select(
        "category_id",
        "category_name",
        (as_double(F.col("price")) / F.nullif(F.col("prices"), F.lit(0))).alias("avg_unit_price"),
        (as_double(F.col("discount")) / F.nullif(F.col("discounts"), F.lit(0))).alias("avg_discount"),
    ).orderBy("category_id")
