"""Named queries over the wholesale tables, each over its whole input."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.plans import analyses, distinct, figures, lattice, layout, marts, model, quality, upkeep
from martlet.sources.schemas import WHOLESALE, WHOLESALE_FOREIGN_KEYS
from martlet.sources.star import Star, read_wholesale, star_from_parquet
from martlet.sources.tables import preview, run_query

Query = Callable[[SparkSession, str], DataFrame]

# Category shares are near 100/6 in the wholesale tables, so this splits them.
SMALL_SHARE = 100 / 6

#: Days between which ``flag_changes`` compares the labels.
CUT_DAYS = (dt.date(1996, 6, 30), dt.date(1997, 6, 30))

_STAR: dict[str, Callable[[Star], DataFrame]] = {
    # sales analyses
    "seller_rank": analyses.seller_rank,
    "kpi_summary": analyses.kpi_summary,
    "best_month": analyses.best_month,
    "headline_cards": analyses.headline_cards,
    "monthly_running_total": analyses.monthly_running_total,
    "mom_growth": analyses.mom_growth,
    "mom_growth_calendar": lambda s: analyses.mom_growth(s, calendar=True),
    "mom_growth_complete": lambda s: analyses.mom_growth(s, complete_periods_only=True),
    "mom_growth_ym": analyses.mom_growth_ym,
    "order_value_flag": analyses.order_value_flag,
    "customer_segments": analyses.customer_segments,
    "category_share": analyses.category_share,
    "category_share_list": lambda s: analyses.category_share(s, price="list"),
    "top3_products": analyses.top_products,
    "top3_by_id": analyses.top_products_by_id,
    "top3_list": lambda s: analyses.top_products_by_id(s, price="list"),
    # report tables and labels
    "seller_tiers": analyses.seller_tiers,
    "seller_dense_rank": analyses.seller_dense_rank,
    "growth_direction": analyses.growth_direction_by_month,
    "growth_extremes": analyses.growth_extremes,
    "growth_table": analyses.growth_table,
    "next_month_delta": analyses.next_month_delta,
    "top15_customers": analyses.top_customers,
    "category_top3_total": analyses.category_top_total,
    "product_share_in_category": analyses.product_share_in_category,
    # exploration
    "order_seller_detail": analyses.order_seller_detail,
    "order_customer_detail": analyses.order_customer_detail,
    "line_product_detail": analyses.line_product_detail,
    "order_customer_sample": lambda s: analyses.order_customer_detail(s, limit=10),
    # report figures
    "topk_share": figures.topk_share,
    "leader_ratio": figures.leader_ratio,
    "category_pareto": figures.category_pareto,
    "small_categories": lambda s: figures.small_categories(s, SMALL_SHARE),
    "max_order_ratio": figures.max_order_ratio,
    "repeat_high_value": figures.repeat_high_value,
    "product_beats_category": figures.product_beats_category,
    "top_orders": figures.top_orders,
    "top1_product": figures.top_product_per_category,
    "repeat_customers": figures.repeat_customers,
    "yoy_growth": figures.yoy_growth,
    # dimensional model
    "dim_date": model.dim_date,
    "dim_product": model.dim_product,
    "dim_customer": model.dim_customer,
    "dim_seller": model.dim_seller,
    "dim_category": model.dim_category,
    "fact_sales": model.fact_sales,
    "revenue_by_nation": lambda s: model.revenue_by(s, "region", "nation"),
    "revenue_by_year_category": lambda s: model.revenue_by(s, "year", "category_name"),
    "revenue_by_weekday": lambda s: model.revenue_by(s, "day_of_week"),
    "revenue_by_seller_nation": lambda s: model.revenue_by(s, "sales_region", "territory"),
    "rollup_from_aggregate": lattice.rollup_from_aggregate,
    "distinct_orders_rollup": distinct.distinct_orders_rollup,
    "avg_price_discount": model.avg_price_discount,
    # results in one pass, and results that are kept up to date
    "marts_figures": marts.marts_figures,
    "monthly_after_append": upkeep.monthly_after_append,
    "seller_rank_laid_out": layout.seller_rank_laid_out,
    "flag_changes": lambda s: upkeep.flag_changes(s, *CUT_DAYS),
    # data quality over the star
    "grain_check": quality.grain_check,
    "fanout_check": quality.fanout_check,
    "reconcile": quality.reconcile,
    "orders_without_lines": quality.orders_without_lines,
}


def _over_star(build: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, root: build(star_from_parquet(spark, root))


def _table_counts(spark: SparkSession, root: str) -> DataFrame:
    star = star_from_parquet(spark, root)
    return analyses.table_counts(
        {
            "orders": star.orders,
            "customers": star.customers,
            "products": star.products,
            "sellers": star.sellers,
            "categories": star.categories,
            "lines": star.lines,
        }
    )


_STATUS_SQL = """
SELECT o_orderpriority, COUNT(*) AS n_orders, MIN(CAST(o_orderdate AS DATE)) AS first_date
FROM {orders} WHERE o_orderstatus = :status GROUP BY o_orderpriority"""


def _sql_text(spark: SparkSession, root: str) -> DataFrame:
    orders = read_wholesale(spark, root)["orders"]
    return run_query(spark, _STATUS_SQL, {"status": "F"}, {"orders": orders})


def _orders_by_status(spark: SparkSession, root: str) -> DataFrame:
    orders = read_wholesale(spark, root)["orders"]
    wanted = ["1-URGENT", "2-HIGH"]
    rows = orders.where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin(wanted))
    return rows.selectExpr("o_orderkey AS order_id", "o_orderstatus AS status", "o_orderpriority AS priority")


_TABLES: dict[str, Query] = {
    "sql_text": _sql_text,
    "orders_by_status": _orders_by_status,
    "table_counts": _table_counts,
    "preview_customers": lambda spark, root: preview(read_wholesale(spark, root)["customer"], "c_custkey"),
    "preview_orders": lambda spark, root: preview(read_wholesale(spark, root)["orders"], "o_orderkey"),
    "key_duplicates": lambda spark, root: quality.key_duplicates(read_wholesale(spark, root), WHOLESALE),
    "fk_orphans": lambda spark, root: quality.fk_orphans(
        read_wholesale(spark, root), WHOLESALE_FOREIGN_KEYS
    ),
    "null_counts": lambda spark, root: quality.null_counts(read_wholesale(spark, root), WHOLESALE),
    "overlong_names": lambda spark, root: quality.overlong_texts(read_wholesale(spark, root), WHOLESALE),
}


def queries() -> dict[str, Query]:
    return {name: _over_star(build) for name, build in _STAR.items()} | _TABLES
