from __future__ import annotations

import pytest
from sales_rows import category, customer, day, employee, line, order, product, rows

from pyspark.sql import functions as F

from martlet.plans import analyses, figures, model, totals

SHOP = dict(
    employees=[employee(1, "Ann", "Lee"), employee(2, "Bob", "Ray"), employee(3, "Cid", "Poe")],
    customers=[customer("A", "Alpha"), customer("B", "Beta"), customer("C", "Gamma")],
    categories=[category(1, "Tea"), category(2, "Rice")],
    products=[product(1, "Green", 1, 10), product(2, "Black", 1, 20), product(3, "Basmati", 2, 5)],
    orders=[
        order(1, "1997-01-05", "A", 1),
        order(2, "1997-01-20", "B", 2),
        order(3, "1997-02-11", "A", 1),
        order(4, "1997-03-02", "B", 3),
    ],
    order_details=[
        line(1, 1, 10, 10),
        line(1, 3, 5, 20, 0.5),
        line(2, 2, 15, 10),
        line(3, 1, 8, 10),
        line(4, 2, 20, 5, 0.25),
    ],
)
# Order values: 150, 150, 80, 75.


@pytest.fixture(scope="module")
def shop(star):
    return star(**SHOP)


def changed(star, **other):
    return star(**{**SHOP, **other})


def test_key_figures(shop):
    assert rows(analyses.kpi_summary(shop)) == [(455.0, 4, 113.75)]


def test_order_without_lines_is_not_counted(star):
    shop = changed(star, orders=SHOP["orders"] + [order(9, "1997-09-09")])
    assert rows(analyses.kpi_summary(shop), "total_orders") == [(4,)]
    assert len(rows(analyses.monthly_running_total(shop))) == 3


def test_best_month_and_cards(shop):
    assert rows(analyses.best_month(shop)) == [(day("1997-01-01"), 300.0)]
    assert rows(analyses.headline_cards(shop)) == [("$455", "4", "$114", "Jan 1997", "$300")]


def test_sellers(shop):
    got = rows(analyses.seller_rank(shop), "seller_name", "total_sales", "sales_rank", "pct_of_total")
    assert got == [
        ("Ann Lee", 230.0, 1, pytest.approx(230 / 455 * 100)),
        ("Bob Ray", 150.0, 2, pytest.approx(150 / 455 * 100)),
        ("Cid Poe", 75.0, 3, pytest.approx(75 / 455 * 100)),
    ]


def test_tied_sellers_share_a_rank(star):
    lines = [line(1, 1, 10, 10), line(2, 1, 10, 10), line(4, 1, 5, 10)]
    shop = changed(star, order_details=lines)
    ranks = dict(rows(analyses.seller_rank(shop), "seller_id", "sales_rank"))
    dense = dict(rows(analyses.seller_dense_rank(shop), "seller_id", "sales_rank"))
    assert ranks == {1: 1, 2: 1, 3: 3} and dense == {1: 1, 2: 1, 3: 2}


def test_seller_tiers(star):
    people = [employee(i, f"F{i}", "L") for i in range(1, 8)]
    shop = changed(
        star,
        employees=people,
        orders=[order(i, "1997-01-01", employee=i) for i in range(1, 8)],
        order_details=[line(i, 1, 100 * i) for i in range(1, 8)],
    )
    got = rows(analyses.seller_tiers(shop), "seller_id", "tier", "rank_label", "sales_label", "share_label")
    assert got[0] == (7, "green", "#1", "$700", "25.0%")
    assert [t for _, t, *_ in got] == ["green"] * 3 + ["amber"] * 2 + ["red"] * 2


def test_order_without_seller_counts_in_figures_only(star):
    shop = changed(star, orders=[order(1, "1997-01-05", employee=None), *SHOP["orders"][1:]])
    assert rows(analyses.kpi_summary(shop), "total_revenue") == [(455.0,)]
    assert sorted(rows(analyses.seller_rank(shop), "seller_id")) == [(1,), (2,), (3,)]
    assert sum(r[0] for r in rows(analyses.seller_rank(shop), "total_sales")) == 305.0


def test_seller_without_first_name(star):
    shop = changed(star, employees=[employee(1, None, "Lee")])
    assert rows(analyses.seller_rank(shop), "seller_id", "seller_name") == [(1, None)]


def test_running_total(shop):
    assert rows(analyses.monthly_running_total(shop)) == [
        (day("1997-01-01"), 300.0, 300.0),
        (day("1997-02-01"), 80.0, 380.0),
        (day("1997-03-01"), 75.0, 455.0),
    ]


def test_order_without_date_sorts_last(star):
    shop = changed(star, orders=[order(1, None, "A", 1), *SHOP["orders"][1:]])
    assert rows(analyses.monthly_running_total(shop))[-1] == (None, 150.0, 455.0)


def test_growth_by_month_and_by_year_and_month(shop):
    want = [None, pytest.approx(-220 / 300 * 100), pytest.approx(-5 / 80 * 100)]
    assert [r[0] for r in rows(analyses.mom_growth(shop), "growth_rate")] == want
    assert rows(analyses.mom_growth_ym(shop)) == [(1997, m, g) for m, g in zip((1, 2, 3), want)]


def test_negative_month_separates_the_two_growth_forms(star):
    shop = changed(star, order_details=[line(1, 1, -10), line(3, 1, 15)])
    assert [r[0] for r in rows(analyses.mom_growth(shop), "growth_rate")] == [None, None]
    assert [r[0] for r in rows(analyses.mom_growth_ym(shop), "growth_rate")] == [None, -250.0]


def test_truncated_last_month_can_be_left_out(star, shop):
    assert len(rows(analyses.mom_growth(shop, complete_periods_only=True))) == 2
    full = changed(star, orders=SHOP["orders"][:3] + [order(4, "1997-03-31", "B", 3)])
    assert len(rows(analyses.mom_growth(full, complete_periods_only=True))) == 3


def test_growth_direction_and_extremes(shop):
    got = rows(analyses.growth_direction_by_month(shop), "month", "direction")
    assert got == [(day("1997-02-01"), "down"), (day("1997-03-01"), "down")]
    found = analyses.growth_extremes(shop).first()
    assert found["best_month"] == day("1997-03-01") and found["worst_month"] == day("1997-02-01")
    assert found["worst_growth_label"] == "-73.3%" and found["best_month_label"] == "Mar 1997"


def test_extremes_of_equal_growth_take_the_earlier_month(star):
    shop = changed(
        star,
        orders=[order(i, f"1997-0{i}-01") for i in (1, 2, 3)],
        order_details=[line(1, 1, 10), line(2, 1, 20), line(3, 1, 40)],
    )
    found = analyses.growth_extremes(shop).first()
    assert found["best_month"] == found["worst_month"] == day("1997-02-01")


def test_next_month(shop):
    assert rows(analyses.next_month_delta(shop), "next_sales", "delta") == [
        (80.0, -220.0),
        (75.0, -5.0),
        (None, None),
    ]


def test_order_flag_is_strict(star, shop):
    got = rows(analyses.order_value_flag(shop), "order_id", "value_category")
    assert got == [(1, "Above Average"), (2, "Above Average"), (3, "Below Average"), (4, "Below Average")]
    even = changed(star, order_details=[line(1, 1, 10), line(2, 1, 10)])
    assert {r[0] for r in rows(analyses.order_value_flag(even), "value_category")} == {"Below Average"}


def test_small_amounts_are_not_cut(star):
    shop = changed(star, order_details=[line(1, i, 0.10, discount=0.0005) for i in range(1, 5)])
    total = analyses.kpi_summary(shop).first()["total_revenue"]
    assert total == 0.3998
    assert round(model.fact_sales(shop).agg(F.sum("net_revenue")).first()[0], 12) == total


def test_growth_table(star):
    sales = [100, 200, 150, 300, 300, 290, 580, 600, 60, 61, 70]
    months = [f"1997-{m:02d}-01" for m in range(1, len(sales) + 1)]
    shop = changed(
        star,
        orders=[order(i, m) for i, m in enumerate(months)],
        order_details=[line(i, 1, s) for i, s in enumerate(sales)],
    )
    got = [(r.direction, r.month.month, r.place) for r in analyses.growth_table(shop).collect()]
    want = [("up", 2, 1), ("up", 4, 2), ("up", 7, 3), ("up", 11, 4), ("up", 8, 5)]
    assert sorted(got) == sorted(want + [("down", 9, 1), ("down", 3, 2), ("down", 6, 3)])


def test_segment_threshold_is_the_mean_over_orders(star):
    # A: nine orders of 10; B: one order of 100. Mean over orders 19, over customers 55.
    shop = changed(
        star,
        orders=[order(i, "1997-01-01", "A") for i in range(1, 10)] + [order(10, "1997-01-01", "C"), order(11, "1997-01-01", "B")],
        order_details=[line(i, 1, 10) for i in range(1, 10)] + [line(10, 1, 40), line(11, 1, 100)],
    )
    got = {r[0]: r[1:] for r in rows(analyses.customer_segments(shop))}
    assert got["A"] == ("Alpha", 9, 90.0, 10.0, "Below Average")
    # 40 is above the mean over orders (20.9) and below the mean of customer means (50).
    assert got["C"] == ("Gamma", 1, 40.0, 40.0, "Above Average")
    assert got["B"] == ("Beta", 1, 100.0, 100.0, "Above Average")


def test_unknown_customer_leaves_segments_and_their_threshold(star):
    shop = changed(star, customers=[customer("A", "Alpha")])
    got = rows(analyses.customer_segments(shop))
    assert got == [("A", "Alpha", 2, 230.0, 115.0, "Below Average")]


def test_top_customers(shop):
    got = rows(analyses.top_customers(shop, 1), "customer_id", "total_spent", "badge")
    assert got == [("A", 230.0, "green")]


def test_category_share_at_both_prices(shop):
    charged = rows(analyses.category_share(shop), "category_name", "total_sales", "sales_pct")
    assert charged == [
        ("Tea", 405.0, pytest.approx(405 / 455 * 100)),
        ("Rice", 50.0, pytest.approx(50 / 455 * 100)),
    ]
    listed = rows(analyses.category_share(shop, price="list"), "category_name", "total_sales")
    assert listed == [("Tea", 475.0), ("Rice", 50.0)]
    with pytest.raises(ValueError):
        analyses.category_share(shop, price="cost")


def test_categories_of_one_name_stay_apart(star):
    shop = changed(star, categories=[category(1, "Tea"), category(2, "Tea")])
    assert sorted(rows(analyses.category_share(shop), "category_id", "category_name")) == [(1, "Tea"), (2, "Tea")]


def test_product_without_category(star):
    products = [product(1, "Green", None, 10), *SHOP["products"][1:]]
    shop = changed(star, products=products)
    assert sum(r[0] for r in rows(analyses.category_share(shop), "total_sales")) == 275.0
    assert {r[0] for r in rows(analyses.top_products(shop), "category_id")} == {1, 2}
    assert {r[0] for r in rows(analyses.top_products_by_id(shop), "category_id")} == {1, 2, None}


def test_top_products(shop):
    got = rows(analyses.top_products(shop, n=1), "category_name", "product_name", "total_sales", "rn")
    assert got == [("Tea", "Black", 225.0, 1), ("Rice", "Basmati", 50.0, 1)]
    listed = rows(analyses.top_products_by_id(shop, n=1, price="list"), "product_name", "total_sales")
    assert listed == [("Black", 275.0), ("Basmati", 50.0)]
    assert rows(analyses.category_top_total(shop)) == [(2, "Rice", 50.0), (1, "Tea", 405.0)]


def test_product_share_in_category(shop):
    got = rows(analyses.product_share_in_category(shop), "product_name", "pct_of_category")
    assert dict(got) == {
        "Green": pytest.approx(180 / 405 * 100),
        "Black": pytest.approx(225 / 405 * 100),
        "Basmati": 100.0,
    }


def test_details(shop):
    assert sorted(rows(analyses.order_seller_detail(shop)))[0] == ("Ann Lee", 1, day("1997-01-05"))
    assert rows(analyses.order_customer_detail(shop, limit=1)) == [(1, "Alpha", None, day("1997-01-05"))]
    assert rows(analyses.line_product_detail(shop, limit=2)) == [
        (1, "Basmati", 20.0, day("1997-01-05")),
        (1, "Green", 10.0, day("1997-01-05")),
    ]


def test_report_figures(shop):
    assert rows(figures.topk_share(shop, 2)) == [(380.0, 455.0, pytest.approx(380 / 455 * 100))]
    assert rows(figures.leader_ratio(shop), "ratio") == [(pytest.approx(230 / 75),)]
    assert rows(figures.category_pareto(shop), "category_name", "cumulative_pct") == [
        ("Tea", pytest.approx(405 / 455 * 100)),
        ("Rice", 100.0),
    ]
    assert rows(figures.small_categories(shop, 20.0), "category_name") == [("Rice",)]
    assert rows(figures.small_categories(shop)) == []
    assert rows(figures.max_order_ratio(shop)) == [(150.0, 113.75, pytest.approx(150 / 113.75))]
    assert rows(figures.repeat_high_value(shop)) == []
    assert rows(figures.repeat_high_value(shop, 1), "customer_id", "high_value_orders") == [("A", 1), ("B", 1)]
    assert rows(figures.top_orders(shop, 1), "order_id") == [(1,)]
    assert rows(figures.top_product_per_category(shop), "product_name") == [("Black",), ("Basmati",)]
    assert rows(figures.repeat_customers(shop), "customer_id", "order_count") == [("A", 2), ("B", 2)]


def test_topk_share_takes_all_sellers_tied_on_the_last_rank(star):
    shop = changed(
        star,
        employees=[employee(i, f"F{i}", "L") for i in range(1, 6)],
        orders=[order(i, "1997-01-01", employee=i) for i in range(1, 6)],
        order_details=[line(1, 1, 50), line(2, 1, 30), line(3, 1, 30), line(4, 1, 30), line(5, 1, 10)],
    )
    # Ranks 1, 2, 2, 2, 5.
    assert rows(figures.topk_share(shop, 2), "top_sales") == [(140.0,)]


def test_product_outsells_other_categories(star, shop):
    got = dict(rows(figures.product_beats_category(shop), "product_name", "categories_beaten"))
    assert got == {"Black": 1, "Basmati": 0}
    # A category pulled below its best product by a negative one does not count itself.
    shop = changed(star, order_details=[line(1, 1, -90), line(1, 2, 100), line(1, 3, 20)])
    got = dict(rows(figures.product_beats_category(shop), "product_name", "categories_beaten"))
    assert got == {"Black": 1, "Basmati": 1}


def test_year_over_year(star):
    shop = changed(
        star,
        orders=[order(1, "1996-01-10"), order(2, "1997-01-20"), order(3, "1997-02-01")],
        order_details=[line(1, 1, 10), line(2, 1, 15), line(3, 1, 1)],
    )
    assert [r[0] for r in rows(figures.yoy_growth(shop), "yoy_pct")] == [None, 50.0, None]


def test_empty_tables(star):
    empty = star()
    assert rows(analyses.kpi_summary(empty)) == [(None, 0, None)]
    assert rows(analyses.headline_cards(empty)) == [(None, "0", None, None, None)]
    assert rows(analyses.growth_extremes(empty), "best_month", "worst_growth") == [(None, None)]
    assert rows(figures.topk_share(empty)) == [(None, None, None)]
    assert rows(figures.max_order_ratio(empty)) == [(None, None, None)]
    for build in (
        analyses.best_month,
        analyses.seller_rank,
        analyses.monthly_running_total,
        analyses.mom_growth,
        analyses.mom_growth_ym,
        analyses.order_value_flag,
        analyses.customer_segments,
        analyses.category_share,
        analyses.top_products,
        analyses.product_share_in_category,
        figures.category_pareto,
        figures.product_beats_category,
        figures.yoy_growth,
    ):
        assert rows(build(empty)) == []


def test_table_counts(tables):
    built = tables(**SHOP)
    got = dict(rows(analyses.table_counts({n: built[n] for n in ("orders", "order_details", "shippers")})))
    assert got == {"order_details": 5, "orders": 4, "shippers": 0}


def test_float_noise_disappears(star):
    shop = changed(star, order_details=[line(1, 1, 9.80000019, 10, 0.150000006)])
    assert rows(analyses.kpi_summary(shop), "total_revenue") == [(83.3,)]
