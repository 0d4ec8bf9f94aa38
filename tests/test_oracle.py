"""Every named query against its SQL twin in another engine, over whole tables."""

from __future__ import annotations

import datetime as dt
import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from martlet import oracle, registry

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="test data is not mounted")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, Decimal):
        return f"decimal {value}"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def test_each_query_has_its_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())
    assert set(registry.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sql, name):
    df = registry.queries()[name](spark, ROOT)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = sql.execute(oracle.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert got == want


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["seller_id", "seller_name", "total_sales", "sales_rank", "pct_of_total"]
    assert df.count() == 10
