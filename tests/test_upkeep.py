"""Roll-ups from stored tables, and results that are kept up to date."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import defaultdict
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from sales_rows import category, customer, day, employee, final_plan, line, order, product, rows
from test_analyses import SHOP, changed

from martlet.plans import analyses, distinct, figures, lattice, layout, marts, model, quality, totals, upkeep
from martlet.sources import freshness
from martlet.sources.star import star_from_parquet

ROOT = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(ROOT).exists(), reason="test data is not mounted")


@pytest.fixture(scope="module")
def shop(star):
    return star(**SHOP)


def scans(plan: str, table: str) -> int:
    ran = plan.split("== Initial Plan ==")[0]
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", ran))


# --- one pass over the lines -----------------------------------------------------


@needs_data
def test_lines_are_read_once_for_all_marts(spark):
    star = star_from_parquet(spark, ROOT)
    plan = final_plan(totals.line_sums(star))
    assert scans(plan, "lineitem") == 1 and "Expand" in plan
    for name, mart in marts.build_marts(star).items():
        assert scans(final_plan(mart), "lineitem") == 0, name


def test_shared_totals_change_no_result(shop):
    shared = totals.share_totals(shop)
    for result in (analyses.seller_rank, analyses.kpi_summary, analyses.mom_growth, analyses.customer_segments, analyses.top_products, analyses.order_value_flag):
        assert rows(result(shared)) == rows(result(shop))


@needs_data
def test_orders_and_products_that_do_not_exist_count_nowhere(spark):
    star = star_from_parquet(spark, ROOT)
    some = star.with_tables(
        orders=star.orders.filter("order_id % 3 > 0"), products=star.products.filter("product_id % 2 > 0")
    )
    shared = totals.share_totals(some)
    for result in (analyses.seller_rank, analyses.kpi_summary, analyses.category_share):
        assert rows(result(shared)) == rows(result(some))


def test_unknown_totals_are_refused(shop):
    with pytest.raises(ValueError, match="unknown totals"):
        shop.with_shared(order_value=shop.orders)


# --- distinct orders ---------------------------------------------------------------


def test_distinct_orders_of_odd_ids(star):
    draw = random.Random(2)
    ids = draw.sample(range(-32000, 32000), 400)
    dates = {i: f"199{draw.randrange(6, 8)}-{draw.randrange(1, 13):02d}-11" if draw.random() < 0.95 else None for i in ids}
    lines = [line(i, p, 1) for i in ids for p in draw.sample(range(1, 7), draw.randrange(0, 4))]
    shop = star(
        orders=[order(i, dates[i]) for i in ids],
        order_details=lines,
        products=[product(p, f"p{p}", None if p == 6 else p % 3) for p in range(1, 7)],
        categories=[category(c, f"c{c}") for c in range(3)],
    )
    want = defaultdict(set)
    for at in lines:
        group = None if at["product_id"] == 6 else at["product_id"] % 3
        when = dates[at["order_id"]] and day(dates[at["order_id"]])
        for level, month in (("month", lambda m: m), ("quarter", lambda m: (m - 1) // 3 * 3 + 1), ("year", lambda m: 1)):
            period = when and dt.date(when.year, month(when.month), 1)
            want[level, period, "all"].add(at["order_id"])
            want[level, period, group].add(at["order_id"])
    bitmaps = distinct.order_bitmaps(shop)
    got = distinct.counted(distinct.merged(bitmaps, "month"), "month").collect()
    assert {("month", r.month, "all"): r.order_count for r in got} == {k: len(v) for k, v in want.items() if k[0] == "month" and k[2] == "all"}
    both = defaultdict(list)
    for r in distinct.distinct_orders(bitmaps).collect():
        both[r.level, r.period, r.category].append(r.order_count)
    wanted = defaultdict(list)
    for (level, period, group), orders in want.items():
        wanted[level, period, None if group in ("all", None) else str(group)].append(len(orders))
    assert {k: sorted(v) for k, v in both.items()} == {k: sorted(v) for k, v in wanted.items()}


@needs_data
def test_distinct_orders_roll_up_without_the_lines(spark):
    bitmaps = distinct.order_bitmaps(star_from_parquet(spark, ROOT))
    plan = final_plan(distinct.distinct_orders(bitmaps))
    assert scans(plan, "lineitem") == scans(plan, "orders") == 0


def test_numbers_follow_month_and_id(shop):
    got = distinct.numbered_orders(shop).orderBy("number").collect()
    assert [r.number for r in got] == list(range(len(got)))
    assert [(r.month, r.order_id) for r in got] == sorted((r.month, r.order_id) for r in got)


# --- territories -------------------------------------------------------------------


def test_territories_share_their_sellers_sales_exactly(star):
    draw = random.Random(5)
    places = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "d"), (3, "d")]
    shop = star(
        employees=[employee(i, f"F{i}", f"L{i}") for i in (1, 2, 3, 4)],
        orders=[order(i, "1997-01-05", employee=draw.choice((1, 2, 3, 4))) for i in range(60)],
        order_details=[line(i, p, draw.choice((0.1, 7.77, 31.01)), draw.randint(1, 9), draw.choice((0.0, 0.15))) for i in range(60) for p in (1, 2)],
        products=[product(1, "x", 1), product(2, "y", 1)],
        employee_territories=[{"employee_id": e, "territory_id": t} for e, t in places],
        territories=[{"territory_id": t, "territory_description": f"{t}town ", "region_id": 1 + (t > "b")} for t in "abcd"],
        region=[{"region_id": 1, "region_description": "East "}, {"region_id": 2, "region_description": "West"}],
    )
    whole = model.exact_measures(shop, "year").first()
    for by in (("sales_region",), ("territory",), ("sales_region", "territory"), ("seller_name", "sales_region")):
        parts = model.exact_measures(shop, *by).collect()
        for measure in ("net_revenue", "gross_revenue", "quantity", "line_count"):
            assert sum(Decimal(str(p[measure])) for p in parts) == Decimal(str(whole[measure])), (by, measure)
    got = {r.territory: r.net_revenue for r in model.exact_measures(shop, "territory").collect()}
    assert set(got) == {"atown", "btown", "ctown", "dtown", None}
    sellers = {r.seller_id: r.net_revenue for r in model.exact_measures(shop, "seller_id").collect()}
    assert got[None] == sellers[4]
    assert abs(got["dtown"] - sellers[2] / 2 - sellers[3]) <= Decimal("0.00000001")
    shares = model.territory_bridge(shop).groupBy("seller_id").agg(F.sum(1 / F.col("territories")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in shares)


def test_further_attributes(star):
    shop = changed(
        star,
        orders=[{**order(1, "1997-01-05"), "ship_via": 1}, {**order(2, "1997-01-06"), "ship_via": 2}],
        order_details=[line(1, 1, 10), line(2, 1, 5), line(2, 2, 1)],
        products=[{**product(1, "x", 1), "supplier_id": 7}, {**product(2, "y", 1), "supplier_id": 8, "discontinued": 1}],
        suppliers=[{"supplier_id": 7, "company_name": "Seven"}, {"supplier_id": 8, "company_name": "Eight"}],
        shippers=[{"shipper_id": 1, "company_name": "Fast"}, {"shipper_id": 2, "company_name": "Slow"}],
        employees=[{**employee(1, "Ann", "Lee"), "title": "Rep", "hire_date": day("1993-01-01")}],
        customers=[{**customer("A", "Alpha"), "contact_name": "Q"}],
    )
    sums = lambda *by: [tuple(r)[: len(by)] + (r.net_revenue,) for r in model.revenue_by(shop, *by).collect()]
    assert sums("supplier_name") == [("Eight", 1.0), ("Seven", 15.0)]
    assert sums("shipper_name") == [("Fast", 10.0), ("Slow", 6.0)]
    assert sums("shipper_id") == [(1, 10.0), (2, 6.0)]
    assert sums("day_of_week") == [(0, 10.0), (1, 6.0)]
    assert sums("title", "hire_date") == [("Rep", day("1993-01-01"), 16.0)]
    assert sums("discontinued") == [(False, 15.0), (True, 1.0)]
    assert sums("contact_name") == [("Q", 16.0)]


# --- stored aggregates -------------------------------------------------------------


@needs_data
def test_the_smallest_aggregate_that_covers_answers(spark):
    star = star_from_parquet(spark, ROOT)
    stored = lattice.Lattice(star).store("order_date", "category_name").store("month", "region", "nation").store("month", "region")
    by = {("year", "region"): 2, ("month", "nation"): 1, ("quarter", "category_name"): 0, ("day_of_week",): 0, ("day_of_week", "region"): None, ("segment",): None}
    for asked, which in by.items():
        assert stored.source(*asked) is (None if which is None else stored.stored[which])
        assert rows(stored.revenue_by(*asked)) == rows(model.revenue_by(star, *asked))
        assert scans(final_plan(stored.revenue_by(*asked)), "lineitem") == (which is None)
    # The third one was built from the second.
    assert scans(final_plan(lattice.Lattice(star, stored.stored[:2]).measures("month", "region")), "lineitem") == 0


# --- upkeep ------------------------------------------------------------------------


def test_only_the_months_of_new_orders_are_replaced(spark, shop, tmp_path):
    path = str(tmp_path / "months")
    upkeep.store_months(shop, path)
    before = {p: p.stat().st_mtime_ns for p in Path(path).glob("month=*/*.parquet")}
    added = shop.orders.filter("order_date >= '1997-03-01'")
    for _ in range(2):  # a repeated append changes nothing
        assert upkeep.append_months(shop, added, path) == [dt.date(1997, 3, 1)]
        got = rows(upkeep.stored_months(spark, path).orderBy("month"))
        assert got == rows(totals.monthly_sales(shop).select("month", "total_sales").orderBy("month"))
    after = {p: p.stat().st_mtime_ns for p in Path(path).glob("month=*/*.parquet")}
    assert {p for p in before if before[p] == after.get(p)} == {p for p in before if "1997-03" not in str(p)}
    assert upkeep.append_months(shop, added.limit(0), path) == []


def test_orders_without_a_date_have_a_folder_too(spark, star, tmp_path):
    shop = changed(star, orders=SHOP["orders"] + [order(99, None)], order_details=SHOP["order_details"] + [line(99, 1, 5)])
    path = str(tmp_path / "months")
    upkeep.store_months(shop.with_tables(orders=shop.orders.filter("order_id <> 99")), path)
    assert upkeep.append_months(shop, shop.orders.filter("order_id = 99"), path) == [None]
    assert {r.month: float(r.total_sales) for r in upkeep.stored_months(spark, path).collect()}[None] == 5.0


@needs_data
def test_changed_labels_read_the_slices_between_the_averages(spark, tmp_path):
    star = star_from_parquet(spark, "/root/testdata/sf0.01")
    path = str(tmp_path / "values")
    upkeep.store_values(star, path)
    days = (dt.date(1995, 3, 1), dt.date(2001, 1, 1))
    changes = upkeep.changed_labels(spark, path, *days)
    got = {r.order_id: (r.label_before, r.label_after) for r in changes.collect()}
    values = [(r.order_id, float(r.order_value), r.order_date) for r in totals.order_values(star).collect()]
    means = [sum(v for _, v, d in values if d <= cut) / sum(d <= cut for _, _, d in values) for cut in days]
    label = lambda v, m: "Above Average" if v > m else "Below Average"
    want = {i: (label(v, means[0]), label(v, means[1])) for i, v, d in values if d <= days[0]}
    assert got and got == {i: pair for i, pair in want.items() if pair[0] != pair[1]}
    folders = {p.name for p in Path(path, "values").iterdir() if p.name.startswith("slice=")}
    scan = re.search(r"PartitionFilters: \[([^\]]*)\]", final_plan(changes))[1]
    assert "slice" in scan and len(folders) > 10
    ends = [int(n) for n in re.findall(r"slice#\d+ [<>]= (-?\d+)", scan)]
    assert len(ends) == 2 and max(ends) - min(ends) <= 1


def test_labels_of_no_orders(spark, star, tmp_path):
    path = str(tmp_path / "values")
    upkeep.store_values(star(), path)
    assert upkeep.changed_labels(spark, path, day("1997-01-01"), day("1998-01-01")).count() == 0


# --- layout and screening ------------------------------------------------------------


@needs_data
@pytest.mark.parametrize("hot_lines", [layout.HOT_LINES, 6])
def test_seller_totals_of_laid_out_facts_move_no_line(spark, hot_lines):
    star = star_from_parquet(spark, ROOT)
    hot = layout.hot_order_ids(star, hot_lines)
    assert (hot.count() > 0) == (hot_lines == 6)
    made = layout.lay_out(star, 4, f"laid_{hot_lines}", hot_lines)
    stored = spark.table(made.lines).count() + made.hot_lines.count()
    assert stored == star.lines.count()
    plan = final_plan(made.seller_sums()).split("== Initial Plan ==")[0]
    # An exchange below the sum would carry net or an order; those there are carry sums by seller.
    assert "hashpartitioning(order_id" not in plan
    want = rows(totals.seller_totals(star).select("seller_id", "total_sales").orderBy("seller_id"))
    assert rows(made.seller_sums().orderBy("seller_id")) == want


def test_a_hot_order_loses_no_row(spark, star):
    lines = [line(1, p, 1.1) for p in range(1, 200)] + [line(2, 1, 7), line(3, 1, 5)]
    shop = changed(star, order_details=lines)
    made = layout.lay_out(shop, 2, "hot_shop", hot_lines=100)
    assert [r.order_id for r in made.hot_orders.collect()] == [1] and made.hot_lines.count() == 199
    got = {r.seller_id: float(r.total_sales) for r in made.seller_sums().collect()}
    assert got == {1: 223.9, 2: 7.0}
    assert rows(analyses.seller_rank(shop.with_shared(seller_sums=made.seller_sums()))) == rows(analyses.seller_rank(shop))


@needs_data
def test_key_screening_exchanges_hashes(spark):
    from martlet.sources.schemas import WHOLESALE
    from martlet.sources.star import read_wholesale

    plan = final_plan(quality.repeated_hashes(read_wholesale(spark, ROOT), WHOLESALE)).split("== Initial Plan ==")[0]
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) == len(WHOLESALE) and all(k.startswith("_groupingexpression") or k.startswith("h#") for k in keys)


@needs_data
def test_lines_are_read_once_to_compare_products_with_categories(spark):
    assert scans(final_plan(figures.product_beats_category(star_from_parquet(spark, ROOT))), "lineitem") == 0


# --- freshness ---------------------------------------------------------------------


def test_results_are_written_only_when_the_input_changes(spark, tmp_path):
    source, root, calls = tmp_path / "in", str(tmp_path / "out"), []
    spark.range(3).write.parquet(str(source / "t"))

    def write(folder):
        calls.append(folder)
        spark.read.parquet(str(source / "t")).write.parquet(f"{folder}/copy")

    refresh = lambda: freshness.refresh(spark, [str(source)], root, write)
    first = refresh()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("unchanged", "no job is expected")
    assert refresh() == first and len(calls) == 1
    assert not tracker.getJobIdsForGroup("unchanged")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.range(5).write.mode("append").parquet(str(source / "t"))
    second = refresh()
    assert second != first and spark.read.parquet(f"{second}/copy").count() == 8
    assert spark.read.parquet(f"{first}/copy").count() == 3  # for readers that began before
    assert freshness.drop_old_versions(spark, root) == [first.rsplit("/", 1)[1]]
    assert spark.read.parquet(f"{second}/copy").count() == 8


def test_a_writer_that_dies_half_way_changes_nothing(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    spark.range(3).write.parquet(str(source / "t"))

    def write(folder):
        spark.range(1).write.parquet(f"{folder}/a")

    def die(folder):
        write(folder)
        raise RuntimeError("died")

    with pytest.raises(RuntimeError):
        freshness.refresh(spark, [str(source)], root, die)
    assert freshness.current(spark, root) is None
    first = freshness.refresh(spark, [str(source)], root, write)
    spark.range(9).write.parquet(str(source / "u"))
    with pytest.raises(RuntimeError):
        freshness.refresh(spark, [str(source)], root, die)
    assert freshness.current(spark, root)["folder"] == first
    assert spark.read.parquet(f"{first}/a").count() == 1
    assert len(freshness.drop_old_versions(spark, root)) == 2
    assert freshness.refresh(spark, [str(source)], root, write) != first
