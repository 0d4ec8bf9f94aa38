"""Declared schemas of the fourteen retail tables, with keys and text lengths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

REQUIRED, OPTIONAL = False, True

# Name, Spark type, longest text and whether NULL is allowed, for each
# column that the users' tables have.
COLUMNS = {
    "categories": (
        ("category_id", "short", None, REQUIRED),
        ("category_name", "string", 15, REQUIRED),
        ("description", "string", None, OPTIONAL),
        ("picture", "binary", None, OPTIONAL),
    ),
    "customer_customer_demo": (
        ("customer_id", "string", 5, REQUIRED),
        ("customer_type_id", "string", 5, REQUIRED),
    ),
    "customer_demographics": (
        ("customer_type_id", "string", 5, REQUIRED),
        ("customer_desc", "string", None, OPTIONAL),
    ),
    "customers": (
        ("customer_id", "string", 5, REQUIRED),
        ("company_name", "string", 40, REQUIRED),
        ("contact_name", "string", 30, OPTIONAL),
        ("contact_title", "string", 30, OPTIONAL),
        ("address", "string", 60, OPTIONAL),
        ("city", "string", 15, OPTIONAL),
        ("region", "string", 15, OPTIONAL),
        ("postal_code", "string", 10, OPTIONAL),
        ("country", "string", 15, OPTIONAL),
        ("phone", "string", 24, OPTIONAL),
        ("fax", "string", 24, OPTIONAL),
    ),
    "employees": (
        ("employee_id", "short", None, REQUIRED),
        ("last_name", "string", 20, REQUIRED),
        ("first_name", "string", 10, REQUIRED),
        ("title", "string", 30, OPTIONAL),
        ("title_of_courtesy", "string", 25, OPTIONAL),
        ("birth_date", "date", None, OPTIONAL),
        ("hire_date", "date", None, OPTIONAL),
        ("address", "string", 60, OPTIONAL),
        ("city", "string", 15, OPTIONAL),
        ("region", "string", 15, OPTIONAL),
        ("postal_code", "string", 10, OPTIONAL),
        ("country", "string", 15, OPTIONAL),
        ("home_phone", "string", 24, OPTIONAL),
        ("extension", "string", 4, OPTIONAL),
        ("photo", "binary", None, OPTIONAL),
        ("notes", "string", None, OPTIONAL),
        ("reports_to", "short", None, OPTIONAL),
        ("photo_path", "string", 255, OPTIONAL),
    ),
    "employee_territories": (
        ("employee_id", "short", None, REQUIRED),
        ("territory_id", "string", 20, REQUIRED),
    ),
    "order_details": (
        ("order_id", "short", None, REQUIRED),
        ("product_id", "short", None, REQUIRED),
        ("unit_price", "float", None, REQUIRED),
        ("quantity", "short", None, REQUIRED),
        ("discount", "float", None, REQUIRED),
    ),
    "orders": (
        ("order_id", "short", None, REQUIRED),
        ("customer_id", "string", 5, OPTIONAL),
        ("employee_id", "short", None, OPTIONAL),
        ("order_date", "date", None, OPTIONAL),
        ("required_date", "date", None, OPTIONAL),
        ("shipped_date", "date", None, OPTIONAL),
        ("ship_via", "short", None, OPTIONAL),
        ("freight", "float", None, OPTIONAL),
        ("ship_name", "string", 40, OPTIONAL),
        ("ship_address", "string", 60, OPTIONAL),
        ("ship_city", "string", 15, OPTIONAL),
        ("ship_region", "string", 15, OPTIONAL),
        ("ship_postal_code", "string", 10, OPTIONAL),
        ("ship_country", "string", 15, OPTIONAL),
    ),
    "products": (
        ("product_id", "short", None, REQUIRED),
        ("product_name", "string", 40, REQUIRED),
        ("supplier_id", "short", None, OPTIONAL),
        ("category_id", "short", None, OPTIONAL),
        ("quantity_per_unit", "string", 20, OPTIONAL),
        ("unit_price", "float", None, OPTIONAL),
        ("units_in_stock", "short", None, OPTIONAL),
        ("units_on_order", "short", None, OPTIONAL),
        ("reorder_level", "short", None, OPTIONAL),
        ("discontinued", "integer", None, REQUIRED),
    ),
    "region": (
        ("region_id", "short", None, REQUIRED),
        ("region_description", "string", 60, REQUIRED),
    ),
    "shippers": (
        ("shipper_id", "short", None, REQUIRED),
        ("company_name", "string", 40, REQUIRED),
        ("phone", "string", 24, OPTIONAL),
    ),
    "suppliers": (
        ("supplier_id", "short", None, REQUIRED),
        ("company_name", "string", 40, REQUIRED),
        ("contact_name", "string", 30, OPTIONAL),
        ("contact_title", "string", 30, OPTIONAL),
        ("address", "string", 60, OPTIONAL),
        ("city", "string", 15, OPTIONAL),
        ("region", "string", 15, OPTIONAL),
        ("postal_code", "string", 10, OPTIONAL),
        ("country", "string", 15, OPTIONAL),
        ("phone", "string", 24, OPTIONAL),
        ("fax", "string", 24, OPTIONAL),
        ("homepage", "string", None, OPTIONAL),
    ),
    "territories": (
        ("territory_id", "string", 20, REQUIRED),
        ("territory_description", "string", 60, REQUIRED),
        ("region_id", "short", None, REQUIRED),
    ),
    "us_states": (
        ("state_id", "short", None, REQUIRED),
        ("state_name", "string", 100, OPTIONAL),
        ("state_abbr", "string", 2, OPTIONAL),
        ("state_region", "string", 50, OPTIONAL),
    ),
}

# Primary keys.
PRIMARY_KEYS = {
    "categories": ("category_id",),
    "customer_customer_demo": ("customer_id", "customer_type_id"),
    "customer_demographics": ("customer_type_id",),
    "customers": ("customer_id",),
    "employees": ("employee_id",),
    "employee_territories": ("employee_id", "territory_id"),
    "order_details": ("order_id", "product_id"),
    "orders": ("order_id",),
    "products": ("product_id",),
    "region": ("region_id",),
    "shippers": ("shipper_id",),
    "suppliers": ("supplier_id",),
    "territories": ("territory_id",),
    "us_states": ("state_id",),
}

# Foreign keys as child table, child column, parent table, parent column.
FOREIGN_KEYS = (
    ("orders", "customer_id", "customers", "customer_id"),
    ("orders", "employee_id", "employees", "employee_id"),
    ("orders", "ship_via", "shippers", "shipper_id"),
    ("order_details", "product_id", "products", "product_id"),
    ("order_details", "order_id", "orders", "order_id"),
    ("products", "category_id", "categories", "category_id"),
    ("products", "supplier_id", "suppliers", "supplier_id"),
    ("territories", "region_id", "region", "region_id"),
    ("employee_territories", "territory_id", "territories", "territory_id"),
    ("employee_territories", "employee_id", "employees", "employee_id"),
    ("customer_customer_demo", "customer_type_id", "customer_demographics", "customer_type_id"),
    ("customer_customer_demo", "customer_id", "customers", "customer_id"),
    ("employees", "reports_to", "employees", "employee_id"),
)

# The wholesale tables, with their published text lengths. Sales
# grain there is order and part; line numbers are not unique.
WHOLESALE_COLUMNS = {
    "region": (
        ("r_regionkey", "integer", None, REQUIRED),
        ("r_name", "string", 25, REQUIRED),
    ),
    "nation": (
        ("n_nationkey", "integer", None, REQUIRED),
        ("n_name", "string", 25, REQUIRED),
        ("n_regionkey", "integer", None, REQUIRED),
    ),
    "customer": (
        ("c_custkey", "long", None, REQUIRED),
        ("c_name", "string", 25, REQUIRED),
        ("c_nationkey", "integer", None, REQUIRED),
        ("c_acctbal", "double", None, REQUIRED),
        ("c_mktsegment", "string", 10, REQUIRED),
    ),
    "supplier": (
        ("s_suppkey", "long", None, REQUIRED),
        ("s_name", "string", 25, REQUIRED),
        ("s_nationkey", "integer", None, REQUIRED),
        ("s_acctbal", "double", None, REQUIRED),
    ),
    "part": (
        ("p_partkey", "long", None, REQUIRED),
        ("p_name", "string", 55, REQUIRED),
        ("p_brand", "string", 10, REQUIRED),
        ("p_type", "string", 25, REQUIRED),
        ("p_size", "integer", None, REQUIRED),
        ("p_retailprice", "double", None, REQUIRED),
    ),
    "orders": (
        ("o_orderkey", "long", None, REQUIRED),
        ("o_custkey", "long", None, REQUIRED),
        ("o_orderstatus", "string", 1, REQUIRED),
        ("o_totalprice", "double", None, REQUIRED),
        ("o_orderdate", "timestamp_ntz", None, REQUIRED),
        ("o_orderpriority", "string", 15, REQUIRED),
    ),
    "lineitem": (
        ("l_orderkey", "long", None, REQUIRED),
        ("l_partkey", "long", None, REQUIRED),
        ("l_suppkey", "long", None, REQUIRED),
        ("l_linenumber", "integer", None, REQUIRED),
        ("l_quantity", "double", None, REQUIRED),
        ("l_extendedprice", "double", None, REQUIRED),
        ("l_discount", "double", None, REQUIRED),
        ("l_tax", "double", None, REQUIRED),
        ("l_returnflag", "string", 1, REQUIRED),
        ("l_linestatus", "string", 1, REQUIRED),
        ("l_shipdate", "timestamp_ntz", None, REQUIRED),
    ),
}
WHOLESALE_PRIMARY_KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_partkey"),
}
WHOLESALE_FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)

Column = tuple[str, str, int | None, bool]


@dataclass(frozen=True)
class TableSpec:
    """A table's Spark schema plus the rules Spark itself does not enforce."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    not_null: tuple[str, ...]
    max_length: dict[str, int]


def table_spec(name: str, columns: Sequence[Column], primary_key: tuple[str, ...] = ()) -> TableSpec:
    """Schema and rules of a table. Fields stay nullable: files are checked, not trusted."""
    schema = T.StructType()
    for column, kind, _, _ in columns:
        schema = schema.add(column, kind)
    return TableSpec(
        name=name,
        schema=schema,
        primary_key=primary_key,
        not_null=tuple(column for column, _, _, nullable in columns if nullable is REQUIRED),
        max_length={column: longest for column, _, longest, _ in columns if longest},
    )


RETAIL = {name: table_spec(name, columns, PRIMARY_KEYS[name]) for name, columns in COLUMNS.items()}
WHOLESALE = {
    name: table_spec(name, columns, WHOLESALE_PRIMARY_KEYS[name])
    for name, columns in WHOLESALE_COLUMNS.items()
}
