from __future__ import annotations

import pytest
from sales_rows import category, customer, day, employee, line, product, rows
from test_analyses import SHOP, changed

from martlet.plans import analyses, model
from martlet.plans.marts import MARTS, build_marts, read_marts, write_marts


@pytest.fixture(scope="module")
def shop(star):
    return star(**SHOP)


def test_date_dimension_is_gapless(shop):
    days = rows(model.dim_date(shop).orderBy("full_date"))
    assert len(days) == 57 and days[0] == (day("1997-01-05"), 1, 1, 1997, 0)
    assert days[-1][0] == day("1997-03-02")


def test_date_dimension_of_no_orders_is_empty(star):
    assert rows(model.dim_date(star())) == []


def test_product_dimension_carries_the_category_name(star):
    shop = changed(star, products=SHOP["products"] + [product(9, "Loose", None, 1)])
    got = {r["product_id"]: r for r in model.dim_product(shop).collect()}
    assert got[1]["category_name"] == "Tea" and got[9]["category_name"] is None
    assert got[1]["list_price"] == 10.0 and got[1]["discontinued"] is False


def test_other_dimensions(star):
    shop = star(
        customers=[{**customer("A", "Alpha"), "country": "Peru", "city": "Lima", "contact_name": "Q"}],
        employees=[{**employee(1, "Ann", "Lee"), "title": "Rep", "hire_date": day("1993-01-01")}],
        categories=[{**category(1, "Tea"), "description": "Leaves"}],
        shippers=[{"shipper_id": 1, "company_name": "Fast"}],
    )
    assert rows(model.dim_customer(shop)) == [("A", "Alpha", "Q", "Lima", "Peru")]
    assert rows(model.dim_seller(shop)) == [(1, "Ann Lee", "Ann", "Lee", "Rep", day("1993-01-01"))]
    assert rows(model.dim_category(shop)) == [(1, "Tea", "Leaves")]
    assert rows(model.dim_shipper(shop)) == [(1, "Fast")]


def test_sales_fact(shop):
    fact = model.fact_sales(shop)
    assert fact.count() == 5
    found = fact.filter("order_id = 1 and product_id = 3").first().asDict()
    assert found == {
        "order_id": 1,
        "product_id": 3,
        "customer_id": "A",
        "seller_id": 1,
        "order_date": day("1997-01-05"),
        "quantity": 20.0,
        "unit_price": 5.0,
        "discount": 0.5,
        "gross_revenue": 100.0,
        "net_revenue": 50.0,
    }


def test_line_of_an_unknown_order_is_no_sale(star):
    shop = changed(star, order_details=SHOP["order_details"] + [line(99, 1, 1000)])
    assert model.fact_sales(shop).count() == 5
    assert sum(r[0] for r in rows(model.revenue_by(shop, "category_name"), "net_revenue")) == 455.0
    assert rows(analyses.kpi_summary(shop), "total_revenue") == [(455.0,)]


@pytest.mark.parametrize(
    "by",
    [
        ("year",),
        ("month",),
        ("order_date", "seller_name"),
        ("customer_name",),
        ("category_name", "month"),
        ("product_name", "customer_id", "seller_id", "quarter"),
    ],
)
def test_every_roll_up_keeps_the_totals(shop, by):
    out = model.revenue_by(shop, *by)
    assert out.columns == [*by, "line_count", "quantity", "gross_revenue", "net_revenue"]
    got = out.groupBy().sum("line_count", "quantity", "gross_revenue", "net_revenue").first()
    assert tuple(got) == (5, 55.0, 530.0, 455.0)


def test_roll_up_values(shop):
    assert rows(model.revenue_by(shop, "seller_name"), "seller_name", "net_revenue") == [
        ("Ann Lee", 230.0),
        ("Bob Ray", 150.0),
        ("Cid Poe", 75.0),
    ]


def test_unknown_attribute_is_refused(shop):
    with pytest.raises(ValueError):
        model.revenue_by(shop, "weekday")
    with pytest.raises(ValueError):
        model.revenue_by(shop)


def test_rates_are_averaged(shop):
    got = rows(model.avg_price_discount(shop), "category_name", "avg_unit_price", "avg_discount")
    assert got == [("Tea", pytest.approx((10 + 15 + 8 + 20) / 4), 0.0625), ("Rice", 5.0, 0.5)]


def test_marts_equal_the_single_analyses(shop, spark, tmp_path):
    marts = build_marts(shop)
    assert tuple(marts) == MARTS
    single = {
        "kpis": analyses.kpi_summary,
        "best_month": analyses.best_month,
        "sellers": analyses.seller_rank,
        "monthly": analyses.monthly_running_total,
        "growth": analyses.mom_growth,
        "customers": analyses.customer_segments,
        "categories": analyses.category_share,
        "top_products": analyses.top_products,
    }
    for name, build in single.items():
        assert rows(marts[name]) == rows(build(shop)), name
    write_marts(marts, str(tmp_path))
    for name, mart in read_marts(spark, str(tmp_path)).items():
        assert sorted(map(str, rows(mart))) == sorted(map(str, rows(marts[name]))), name
