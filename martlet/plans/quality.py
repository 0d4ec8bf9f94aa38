"""Data-quality jobs: the constraints a database enforces, run as Spark checks.

Each returns the violating rows or one row per rule with a count. Children are
counted per key before they meet their parent, so a key with very many rows is
one row by then.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions import as_double, exact_sum
from martlet.operators import running_total, share_of_total
from martlet.plans.totals import (
    category_totals,
    customer_totals,
    monthly_sales,
    order_values,
    product_totals,
    seller_totals,
    share_totals,
)
from martlet.session import materialise
from martlet.sources.schemas import TableSpec
from martlet.sources.star import Star


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicate_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def grain_check(star: Star) -> DataFrame:
    """Violations of the fact's grain, one order and product per line."""
    return duplicate_keys(star.lines, ["order_id", "product_id"])


def _key_hash(keys: Iterable[str]) -> Column:
    return F.xxhash64(*keys)


def repeated_hashes(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]) -> DataFrame:
    """``table_name`` and ``h`` of key hashes that occur more than once.

    What is exchanged is a hash and a count, 16 bytes a key, however wide the key is.
    """
    screens = [
        tables[n].groupBy(_key_hash(s.primary_key).alias("h")).agg(F.count("*").alias("n")).filter("n > 1")
        .select(F.lit(n).alias("table_name"), "h")
        for n, s in specs.items()
        if s.primary_key
    ]
    return _union(screens)


def key_duplicates(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]) -> DataFrame:
    """Per table: repeated primary keys and the rows they add.

    Equal keys have equal hashes, so only rows whose hash occurs more than once are
    compared by their keys. The repeated hashes are written first: as their size is
    then known, the rows that are looked at again stay where they are.
    """
    suspects = materialise(repeated_hashes(tables, specs), "repeated-hashes")

    def check(name: str, spec: TableSpec) -> DataFrame:
        own = suspects.filter(F.col("table_name") == name).select("h")
        keys = tables[name].select(*spec.primary_key)
        again = keys.join(own, _key_hash(spec.primary_key) == F.col("h"), "left_semi")
        found = duplicate_keys(again, spec.primary_key).agg(
            F.count("*").alias("repeated_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
        )
        return found.select(
            F.lit(name).alias("table_name"),
            F.lit(", ".join(spec.primary_key)).alias("key_columns"),
            "repeated_keys",
            "surplus_rows",
        )

    return _union(check(n, s) for n, s in specs.items() if s.primary_key)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Key values of ``child`` without a row in ``parent``, with their number of rows.
    NULL keys are allowed."""
    used = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key"))
    known = parent.select(F.col(parent_column).alias("_key"))
    return used.agg(F.count("*").alias("n")).join(known, "_key", "left_anti")


def fk_orphans(
    tables: Mapping[str, DataFrame], foreign_keys: Iterable[tuple[str, str, str, str]]
) -> DataFrame:
    """Per foreign key: orphaned keys and rows."""

    def check(child: str, column: str, parent: str, parent_column: str) -> DataFrame:
        found = orphans(tables[child], column, tables[parent], parent_column)
        return found.agg(
            F.count("*").alias("orphan_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows")
        ).select(
            F.lit(child).alias("child_table"),
            F.lit(column).alias("child_column"),
            F.lit(parent).alias("parent_table"),
            "orphan_keys",
            "orphan_rows",
        )

    return _union(check(*key) for key in foreign_keys)


def null_counts(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]) -> DataFrame:
    """Per NOT NULL column: how many values are NULL. One pass per table."""

    def check(name: str, columns: tuple[str, ...]) -> DataFrame:
        counts = tables[name].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        return counts.unpivot([], list(columns), "column_name", "null_count").select(
            F.lit(name).alias("table_name"), "column_name", "null_count"
        )

    return _union(check(n, s.not_null) for n, s in specs.items() if s.not_null)


def overlong_texts(tables: Mapping[str, DataFrame], specs: Mapping[str, TableSpec]) -> DataFrame:
    """Per text column with a declared length: values that exceed it. One pass per table."""

    def check(name: str, limits: Mapping[str, int]) -> DataFrame:
        counts = tables[name].agg(*[F.count_if(F.length(c) > n).alias(c) for c, n in limits.items()])
        allowed = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        return counts.unpivot([], list(limits), "column_name", "overlong").select(
            F.lit(name).alias("table_name"),
            "column_name",
            allowed[F.col("column_name")].cast("bigint").alias("max_length"),
            "overlong",
        )

    return _union(check(n, s.max_length) for n, s in specs.items() if s.max_length)


def fanout_check(star: Star) -> DataFrame:
    """Per join of the lines with a table of the star: whether it multiplies lines,
    and revenue with and without.

    The joined row count follows from the rows per key on each side, so the
    multiplied rows are never produced.
    """
    dimensions = {
        "order_id": ("orders", star.orders),
        "product_id": ("products", star.products),
        "customer_id": ("customers", star.customers),
        "seller_id": ("sellers", star.sellers),
    }

    def per_key(key: str) -> DataFrame:
        if key in star.lines.columns:
            return star.lines.groupBy(key).agg(F.count("*").alias("n"), exact_sum("net").alias("net"))
        reached = per_key("order_id").join(star.orders.select("order_id", key), "order_id")
        return reached.groupBy(key).agg(F.sum("n").alias("n"), F.sum("net").alias("net"))

    def check(key: str) -> DataFrame:
        name, dimension = dimensions[key]
        right = dimension.groupBy(key).agg(F.count("*").alias("m"))
        copies = F.col("m").cast("decimal(10,0)")
        sums = per_key(key).join(right, key).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("rows_after"),
            as_double(F.sum("net")).alias("net_before"),
            as_double(F.sum(F.col("net") * copies)).alias("net_after"),
        )
        return sums.select(
            F.lit(name).alias("joined_table"),
            "*",
            (F.col("rows_after") > F.col("rows_before")).alias("multiplied"),
        )

    return _union(check(k) for k in dimensions)


def reconcile(star: Star) -> DataFrame:
    """Invariants of the reports, one row per rule: totals agree and shares add up to 100.

    All rules work on totals that are summed once, in one pass over the lines.
    """
    star = share_totals(star)
    total = as_double(order_values(star).agg(F.sum("order_value")).scalar())
    sold = as_double(product_totals(star).agg(F.sum("total_sales")).scalar())
    running = running_total(monthly_sales(star), "month", "total_sales", short_series=True)
    last = F.max_by("running_total", F.struct(F.col("month").isNull(), F.col("month")))

    def rule(name: str, expected, actual: DataFrame) -> DataFrame:
        return actual.toDF("actual").select(
            F.lit(name).alias("rule"), F.round(expected, 4).alias("expected"), F.round("actual", 4).alias("actual")
        )

    def share_sum(df: DataFrame) -> DataFrame:
        return share_of_total(df, "total_sales", "pct").agg(F.sum("pct"))

    def money_sum(df: DataFrame, column: str) -> DataFrame:
        return df.agg(as_double(F.sum(column)))

    hundred = F.lit(100.0)
    rows = _union(
        [
            rule("running total ends at total revenue", total, running.agg(as_double(last))),
            rule("months add up to total revenue", total, money_sum(monthly_sales(star), "total_sales")),
            rule("customers add up to total revenue", total, money_sum(customer_totals(star), "total_spent")),
            rule("sellers add up to total revenue", total, money_sum(seller_totals(star), "total_sales")),
            rule("categories add up to product sales", sold, money_sum(category_totals(star), "total_sales")),
            rule("seller shares add up to 100", hundred, share_sum(seller_totals(star))),
            rule("category shares add up to 100", hundred, share_sum(category_totals(star))),
        ]
    )
    return rows.withColumn("holds", F.col("expected").eqNullSafe(F.col("actual")))


def orders_without_lines(star: Star) -> DataFrame:
    """Orders that every revenue measure leaves out."""
    used = star.lines.select("order_id").distinct()
    return star.orders.join(used, "order_id", "left_anti").select("order_id", "customer_id", "order_date")
