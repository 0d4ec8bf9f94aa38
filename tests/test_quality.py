from __future__ import annotations

import pytest
from sales_rows import category, customer, employee, line, order, product, rows

from martlet.plans import quality
from martlet.sources.schemas import FOREIGN_KEYS, RETAIL

CLEAN = dict(
    employees=[employee(1, "Ann", "Lee")],
    customers=[customer("A", "Alpha")],
    categories=[category(1, "Tea")],
    products=[product(1, "Green", 1), product(2, "Black", 1)],
    orders=[order(1, "1997-01-05"), order(2, "1997-01-06")],
    order_details=[line(1, 1, 10, 2), line(1, 2, 5), line(2, 1, 3)],
)


def spoiled(**other):
    return {**CLEAN, **other}


def test_clean_tables_have_no_violation(tables, star):
    clean = tables(**CLEAN)
    assert rows(quality.grain_check(star(**CLEAN))) == []
    assert {r[0] for r in rows(quality.key_duplicates(clean, RETAIL), "repeated_keys")} == {0}
    assert {r[0] for r in rows(quality.fk_orphans(clean, FOREIGN_KEYS), "orphan_rows")} == {0}
    assert {r[0] for r in rows(quality.null_counts(clean, RETAIL), "null_count")} == {0}
    assert {r[0] for r in rows(quality.overlong_texts(clean, RETAIL), "overlong")} == {0}
    assert rows(quality.orders_without_lines(star(**CLEAN))) == []


def test_every_rule_has_a_row(tables):
    empty = tables()
    assert quality.key_duplicates(empty, RETAIL).count() == 14
    assert quality.fk_orphans(empty, FOREIGN_KEYS).count() == 13
    assert quality.null_counts(empty, RETAIL).count() == sum(len(s.not_null) for s in RETAIL.values())
    assert quality.overlong_texts(empty, RETAIL).count() == sum(len(s.max_length) for s in RETAIL.values())


def test_repeated_grain_is_reported_and_sums_stay(tables, star):
    bad = spoiled(order_details=CLEAN["order_details"] + [line(1, 1, 10, 2)] * 2)
    assert rows(quality.grain_check(star(**bad))) == [(1, 1, 3)]
    found = {r["table_name"]: r for r in quality.key_duplicates(tables(**bad), RETAIL).collect()}
    assert found["order_details"]["repeated_keys"] == 1 and found["order_details"]["surplus_rows"] == 2
    totals = dict(rows(quality.reconcile(star(**bad)), "rule", "holds"))
    assert all(totals.values())


def test_orphans_are_counted_and_null_keys_allowed(tables):
    bad = spoiled(
        orders=CLEAN["orders"] + [order(3, "1997-01-07", customer=None), order(4, "1997-01-08", customer="Z")],
        order_details=CLEAN["order_details"] + [line(1, 9, 1), line(2, 9, 1), line(2, 8, 1)],
    )
    found = {(r[0], r[1]): r[3:] for r in rows(quality.fk_orphans(tables(**bad), FOREIGN_KEYS))}
    assert found["order_details", "product_id"] == (2, 3)
    assert found["orders", "customer_id"] == (1, 1)
    assert found["orders", "ship_via"] == (0, 0)
    built = tables(**bad)
    lost = quality.orphans(built["order_details"], "product_id", built["products"], "product_id")
    assert sorted(rows(lost)) == [(8, 1), (9, 2)]


def test_missing_and_overlong_values(tables):
    bad = spoiled(categories=[category(1, "Tea"), category(2, None), category(3, "x" * 16), category(4, "é" * 15)])
    nulls = {(r[0], r[1]): r[2] for r in rows(quality.null_counts(tables(**bad), RETAIL))}
    assert nulls["categories", "category_name"] == 1 and nulls["categories", "category_id"] == 0
    long = {(r[0], r[1]): r[2:] for r in rows(quality.overlong_texts(tables(**bad), RETAIL))}
    assert long["categories", "category_name"] == (15, 1)


def test_join_that_multiplies_rows_is_found(star):
    bad = spoiled(products=CLEAN["products"] + [product(1, "Green again", 1)])
    found = {r["joined_table"]: r for r in quality.fanout_check(star(**bad)).collect()}
    assert found["products"]["multiplied"] and found["products"]["rows_before"] == 3
    assert found["products"]["rows_after"] == 5
    assert found["products"]["net_before"] == 28.0 and found["products"]["net_after"] == 51.0
    assert not found["orders"]["multiplied"] and not found["customers"]["multiplied"]


def test_reports_reconcile(star):
    found = rows(quality.reconcile(star(**CLEAN)))
    assert len(found) == 7 and all(r[3] for r in found)


def test_reconcile_finds_lost_revenue(star):
    bad = spoiled(customers=[], employees=[])
    found = dict(rows(quality.reconcile(star(**bad)), "rule", "holds"))
    assert not found["customers add up to total revenue"] and not found["sellers add up to total revenue"]
    assert found["running total ends at total revenue"]


def test_reconcile_running_total_with_a_negative_last_month(star):
    bad = spoiled(orders=[order(1, "1997-01-05"), order(2, "1997-02-06")], order_details=[line(1, 1, 10), line(2, 1, -4)])
    assert dict(rows(quality.reconcile(star(**bad)), "rule", "holds"))["running total ends at total revenue"]


def test_orders_without_lines(star):
    bad = spoiled(orders=CLEAN["orders"] + [order(7, "1997-03-01")])
    assert rows(quality.orders_without_lines(star(**bad)), "order_id") == [(7,)]


@pytest.mark.parametrize("hot", [1, 2])
def test_duplicate_keys_of_a_composite_key(spark, hot):
    df = spark.createDataFrame([(1, hot)] * 4 + [(2, 1)], "a int, b int")
    assert rows(quality.duplicate_keys(df, ["a", "b"])) == [(1, hot, 4)]
