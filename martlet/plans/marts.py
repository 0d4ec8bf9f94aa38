"""All dashboard results in one go, over shared totals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.plans import analyses
from martlet.plans.totals import share_totals
from martlet.sources.star import Star
from martlet.sources.writers import write_table

MARTS = ("kpis", "best_month", "sellers", "monthly", "growth", "customers", "categories", "top_products")


def build_marts(star: Star) -> dict[str, DataFrame]:
    """The eight dashboard results over shared totals."""
    star = share_totals(star)
    return {
        "kpis": analyses.kpi_summary(star),
        "best_month": analyses.best_month(star),
        "sellers": analyses.seller_rank(star),
        "monthly": analyses.monthly_running_total(star),
        "growth": analyses.mom_growth(star),
        "customers": analyses.customer_segments(star),
        "categories": analyses.category_share(star),
        "top_products": analyses.top_products(star),
    }


def write_marts(marts: Mapping[str, DataFrame], root: str) -> None:
    """Save each result under ``root/<name>`` for other jobs and the presentation layer.

    The results are independent, so their jobs are submitted together and small
    ones fill the cores that large ones leave free.
    """
    with ThreadPoolExecutor(len(marts)) as pool:
        list(pool.map(lambda name: write_table(marts[name], f"{root}/{name}"), marts))


def read_marts(spark: SparkSession, root: str, names: Iterable[str] = MARTS) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in names}


def marts_figures(star: Star) -> DataFrame:
    """The main figures of all marts as one table: ``mart``, ``item``, ``figure``.

    Items are keys or names as text, so that reports can be compared row by row.
    """
    marts = build_marts(star)

    def figures(mart: str, item: str | Column, figure: str, name: str | None = None) -> DataFrame:
        item = F.col(item) if isinstance(item, str) else item
        return marts[mart].select(
            F.lit(name or mart).alias("mart"), item.cast("string").alias("item"), F.col(figure).cast("double").alias("figure")
        )

    parts = [
        *(figures("kpis", F.lit(k), k) for k in ("total_revenue", "total_orders", "avg_order_value")),
        figures("best_month", "month", "total_sales"),
        figures("sellers", "seller_id", "total_sales"),
        figures("sellers", "seller_id", "sales_rank", "seller_ranks"),
        figures("sellers", "seller_id", "pct_of_total", "seller_shares"),
        figures("monthly", "month", "total_sales"),
        figures("monthly", "month", "running_total", "running"),
        figures("growth", "month", "growth_rate"),
        figures("customers", "customer_id", "total_spent"),
        figures("customers", "customer_id", "order_count", "customer_orders"),
        figures("categories", "category_id", "total_sales"),
        figures("categories", "category_id", "sales_pct", "category_shares"),
        figures("top_products", "product_id", "total_sales"),
    ]
    return reduce(DataFrame.unionByName, parts)
