"""From an INSERT dump to saved dashboard results, over declared retail tables."""

from __future__ import annotations

import pytest
from sales_rows import rows

from martlet.plans import analyses, model, quality
from martlet.plans.marts import MARTS, build_marts, read_marts, write_marts
from martlet.sources import convert_dump, read_tables, register_views, run_query, star_from_retail
from martlet.sources.schemas import FOREIGN_KEYS, RETAIL


def dump_text() -> str:
    """Three sellers, four customers, two categories; prices as float32 prints them."""
    out = ["-- generated"]
    put = lambda table, *values: out.append(f"INSERT INTO {table} VALUES ({', '.join(values)});")
    for i, name in ((1, "'Drinks'"), (2, "'Chef''s best'")):
        put("categories", str(i), name, "NULL", r"'\x'")
    for i in range(1, 5):
        put("customers", f"'CUST{i}'", f"'Customer, No. {i}'", *["NULL"] * 9)
    for i, first in ((1, "'Ann'"), (2, "'Bob'"), (3, "'Cid'")):
        photo = [r"'\x'", "'Notes (long); with '' quote'", "NULL" if i == 1 else "1", "NULL"]
        put("employees", str(i), "'Lee'", first, *["NULL"] * 11, *photo)
    for i in range(1, 7):
        price = "9.80000019" if i == 1 else f"{i}.5"
        put("products", str(i), f"'Product {i}'", "NULL", str(1 + i % 2), "NULL", price, "0", "0", "0", str(i % 2))
    put("shippers", "1", "'Fast'", "NULL")
    for i in range(1, 41):
        day = f"'{1996 + i // 20}-{1 + i % 12:02d}-{1 + i % 28:02d}'"
        put("orders", str(i), f"'CUST{1 + i % 4}'", str(1 + i % 3), day, "NULL", "NULL", "1", "1.5", *["NULL"] * 6)
        for p in (1 + i % 6, 1 + (i + 1) % 6):
            price = "9.80000019" if p == 1 else f"{p}.25"
            put("order_details", str(i), str(p), price, str(1 + i % 5), "0.0500000007" if i % 3 == 0 else "0")
    return "\n".join(out) + "\n"


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("retail")
    (folder / "dump.sql").write_text(dump_text(), encoding="utf-8")
    convert_dump(spark, str(folder / "dump.sql"), str(folder / "tables"))
    return read_tables(spark, str(folder / "tables"))


def expected_total() -> float:
    total = 0
    for i in range(1, 41):
        for p in (1 + i % 6, 1 + (i + 1) % 6):
            cents = 980 if p == 1 else p * 100 + 25
            total += cents * (1 + i % 5) * (95 if i % 3 == 0 else 100)
    return total / 10_000


def test_loaded_tables_pass_the_checks(loaded):
    assert loaded["order_details"].count() == 80 and loaded["employees"].count() == 3
    for check, column in (
        (quality.key_duplicates(loaded, RETAIL), "repeated_keys"),
        (quality.fk_orphans(loaded, FOREIGN_KEYS), "orphan_rows"),
        (quality.null_counts(loaded, RETAIL), "null_count"),
        (quality.overlong_texts(loaded, RETAIL), "overlong"),
    ):
        assert {r[0] for r in rows(check, column)} == {0}


def test_results_agree_with_plain_arithmetic(loaded):
    star = star_from_retail(loaded)
    total = expected_total()
    assert rows(analyses.kpi_summary(star)) == [(total, 40, total / 40)]
    assert sum(r[0] for r in rows(analyses.seller_rank(star), "total_sales")) == pytest.approx(total)
    assert all(r[3] for r in rows(quality.reconcile(star)))
    assert {r[0] for r in rows(analyses.category_share(star), "category_name")} == {"Drinks", "Chef's best"}


def test_sql_text_agrees_with_the_roll_up(spark, loaded):
    register_views(loaded)
    sql = run_query(
        spark,
        """
        SELECT product_name, COUNT(*) AS n, CAST(SUM(quantity) AS DOUBLE) AS q
        FROM order_details JOIN products USING (product_id)
        WHERE product_id >= :first GROUP BY product_name ORDER BY product_name
        """,
        {"first": 1},
    )
    rolled = model.revenue_by(star_from_retail(loaded), "product_name")
    assert rows(sql) == rows(rolled, "product_name", "line_count", "quantity")


def test_marts_are_saved(spark, loaded, tmp_path):
    star = star_from_retail(loaded)
    write_marts(build_marts(star), str(tmp_path))
    saved = read_marts(spark, str(tmp_path))
    assert tuple(saved) == MARTS
    assert saved["kpis"].first()["total_orders"] == 40
    assert saved["customers"].count() == 4 and saved["sellers"].count() == 3
