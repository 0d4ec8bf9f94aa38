"""Plans must hold when every table is large: broadcasts by size are off here."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from sales_rows import final_plan, rows
from pyspark.sql import functions as F

from martlet import registry
from martlet.plans import analyses, model, totals
from martlet.session import SETTINGS
from martlet.sources.star import Star, star_from_parquet

ROOT = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(ROOT).exists(), reason="test data is not mounted")


@pytest.fixture
def conf(spark):
    changed = {}

    def put(**settings):
        for key, value in settings.items():
            name = "spark.sql." + key.replace("__", ".")
            changed.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in changed.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


@pytest.fixture
def no_broadcast(conf):
    conf(autoBroadcastJoinThreshold="-1")


def executed(plan: str) -> str:
    """The plan that ran, without the initial plans it started from."""
    kept, skip = [], None
    for text in plan.splitlines():
        depth = len(text) - len(text.lstrip(" :+-"))
        if skip is not None and depth >= skip:
            continue
        skip = None
        if "== Initial Plan ==" in text:
            skip = depth
            continue
        kept.append(text)
    return "\n".join(kept)


def query(spark, name):
    return executed(final_plan(registry.queries()[name](spark, ROOT)))


def single_partition_inputs(plan: str) -> list[str]:
    """The operator whose output each single-partition exchange collects."""
    found = plan.split("Exchange SinglePartition")[1:]
    return [re.sub(r"^[\s:+\-*()\d]+", "", part.split("\n")[1]).split("(")[0].split(" ")[0] for part in found]


@needs_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_pairs_no_python_no_broadcast(spark, no_broadcast, name):
    plan = query(spark, name)
    unwanted = ["CartesianProduct", "BroadcastNestedLoopJoin", "Python"]
    if not name.endswith("_sliced"):  # those broadcast one row per slice
        unwanted.append("BroadcastExchange")
    assert [u for u in unwanted if u in plan] == []


@needs_data
@pytest.mark.parametrize(
    "name",
    [
        "kpi_summary",
        "order_value_flag",
        "customer_segments",
        "repeat_high_value",
        "max_order_ratio",
        "product_share_in_category",
        "category_share",
        "category_share_list",
        "top3_products",
        "fact_sales",
        "order_seller_detail",
        "order_customer_detail",
        "line_product_detail",
        "grain_check",
        "fk_orphans",
        "fanout_check",
        "key_duplicates",
        "orders_without_lines",
        "revenue_by_nation",
        "leader_ratio",
    ],
)
def test_only_partial_sums_are_collected_in_one_task(spark, no_broadcast, name):
    # A partial aggregate without keys sends one row per task.
    assert set(single_partition_inputs(query(spark, name))) <= {"HashAggregate"}


@needs_data
@pytest.mark.parametrize(
    "name,scans",
    [
        ("seller_rank", 1),
        ("kpi_summary", 1),
        ("monthly_running_total", 1),
        ("mom_growth", 1),
        ("yoy_growth", 1),
        ("order_value_flag", 1),
        ("customer_segments", 1),
        ("category_share", 1),
        ("category_pareto", 1),
        ("product_share_in_category", 1),
        # Known cost: its slice borders and its rows read the lines once each.
        ("product_beats_category", 2),
        ("topk_share", 1),
        ("top3_products", 1),
        ("avg_price_discount", 1),
        ("revenue_by_nation", 1),
        ("fact_sales", 1),
    ],
)
def test_lines_are_read_once(spark, no_broadcast, name, scans):
    # A shuffle that feeds both the rows and a figure over all rows is reused.
    assert len(re.findall(r"FileScan parquet \[l_", query(spark, name))) == scans


@needs_data
@pytest.mark.parametrize("by", [("month", "category_name", "region", "nation"), ("year", "category_name")])
def test_lines_are_summed_on_few_values(spark, no_broadcast, by):
    # Sums by customer and product, or by month and product, would be nearly as many as the lines, and wider.
    star = star_from_parquet(spark, ROOT)
    plan = executed(final_plan(model.exact_measures(star, *by)))
    summed = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan) or re.findall(r"HashAggregate.*keys=\[([^\]]*)\]", plan)
    assert summed and not [keys for keys in summed if "customer_id" in keys or "product_id" in keys]
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1


@needs_data
def test_scans_read_only_needed_columns_and_push_filters(spark, no_broadcast):
    plan = query(spark, "kpi_summary")
    lines = next(t for t in plan.splitlines() if "FileScan parquet [l_" in t)
    assert re.search(r"FileScan parquet \[l_orderkey#\w+,l_extendedprice#\w+,l_discount#\w+\]", lines)
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in lines
    orders = next(t for t in plan.splitlines() if "FileScan parquet [o_" in t)
    assert re.search(r"FileScan parquet \[o_orderkey#\w+\]", orders)


@needs_data
def test_lines_are_summed_before_they_are_shuffled(spark, no_broadcast):
    plan = query(spark, "customer_segments")
    for part in plan.split("Exchange hashpartitioning")[1:]:
        if "FileScan parquet [l_" in part:
            assert "partial_sum" in part.split("FileScan")[0]


@needs_data
def test_top_products_are_limited_before_the_shuffle(spark, no_broadcast):
    plan = query(spark, "top3_products")
    assert re.search(r"Exchange hashpartitioning\(category_id.*\n.*WindowGroupLimit.*Partial", plan)


@needs_data
def test_checked_orders_need_no_join(spark, no_broadcast):
    star = star_from_parquet(spark, ROOT)
    builds = (analyses.seller_rank, lambda s: model.revenue_by(s, "category_name", "seller_name"))
    for build in builds:
        checked = build(star.with_orders_checked())
        plan = executed(final_plan(checked))
        assert "FileScan parquet [o_" not in plan and plan.count("FileScan parquet [l_") == 1
        assert rows(checked) == rows(build(star))
    assert "FileScan parquet [o_" in executed(final_plan(model.revenue_by(star.with_orders_checked(), "year")))


# --- skew ------------------------------------------------------------------------

HOT = 20_000


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A star where one order, one product and one customer hold a third of all lines."""
    root = str(tmp_path_factory.mktemp("skewed"))
    n = 3 * HOT
    hot = F.col("id") < HOT
    spark.range(n).select(
        F.when(hot, 0).otherwise(F.col("id") % 5000).alias("order_id"),
        F.when((F.col("id") % 3) == 0, 0).otherwise(F.col("id") % 700).alias("product_id"),
        (F.col("id") % 50).alias("seller_id"),
        F.lit(1.0).alias("quantity"),
        (F.col("id") % 90).cast("double").alias("unit_price"),
        F.lit(0.1).alias("discount"),
        (F.col("id") % 90).cast("double").alias("gross"),
        ((F.col("id") % 90) * 0.9).alias("net"),
    ).write.parquet(f"{root}/lines")
    spark.range(5000).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("customer_id"),
        F.date_add(F.lit("1997-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("order_date"),
    ).write.parquet(f"{root}/orders")
    spark.range(700).selectExpr(
        "id AS product_id", "concat('p', id) AS product_name", "id % 4 AS category_id", "1.0D AS list_price"
    ).write.parquet(f"{root}/products")
    names = {
        "categories": spark.range(4).selectExpr("id AS category_id", "concat('c', id) AS category_name"),
        "customers": spark.range(40).selectExpr("id AS customer_id", "concat('k', id) AS customer_name"),
        "sellers": spark.range(50).selectExpr("id AS seller_id", "concat('s', id) AS seller_name"),
    }
    read = {t: spark.read.parquet(f"{root}/{t}") for t in ("lines", "orders", "products")}
    return Star(**read, **names)


@pytest.fixture
def small_skew(conf, no_broadcast):
    conf(
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20k",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__advisoryPartitionSizeInBytes="20k",
    )


@pytest.mark.parametrize(
    "build", [model.fact_sales, analyses.line_product_detail, totals.seller_totals, analyses.product_share_in_category]
)
def test_joins_of_lines_split_a_hot_key(skewed, small_skew, build):
    if build is analyses.product_share_in_category:
        # Totals per product: the hot product is one row by now, nothing is left to split.
        assert build(skewed).count() == 700
        return
    plan = executed(final_plan(build(skewed)))
    assert "skew=true" in plan


def test_skewed_results_are_whole(skewed, small_skew):
    lines = skewed.lines.count()
    assert model.fact_sales(skewed).count() == lines == 3 * HOT
    assert analyses.line_product_detail(skewed).count() == lines
    total = skewed.lines.agg(F.sum("net")).first()[0]
    assert rows(analyses.kpi_summary(skewed), "total_revenue")[0][0] == pytest.approx(total)
    for build, column in (
        (analyses.seller_rank, "total_sales"),
        (analyses.customer_segments, "total_spent"),
        (analyses.category_share, "total_sales"),
        (analyses.monthly_running_total, "total_sales"),
    ):
        assert build(skewed).agg(F.sum(column)).first()[0] == pytest.approx(total)


def test_settings_split_skewed_joins():
    assert SETTINGS["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert SETTINGS["spark.sql.adaptive.forceOptimizeSkewedJoin"] == "true"
