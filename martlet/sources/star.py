"""One star schema for every analysis, whatever the tables are called at source."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlet.functions import as_double, full_name, gross_revenue, net_of
from martlet.sources.schemas import WHOLESALE


TABLES = (
    "orders",
    "lines",
    "products",
    "categories",
    "customers",
    "sellers",
    "places",
    "shippers",
    "suppliers",
    "territories",
)
#: Totals that ``Star.with_shared`` takes.
SHARED = ("order_values", "product_totals_charged", "product_totals_list", "seller_sums", "monthly_sales")

Table = DataFrame | Callable[[], DataFrame]


class Star:
    """Fact and dimension tables under common column names.

    orders      order_id, customer_id, order_date [shipper_id], seller_id unless sellers are on the lines
    lines       order_id, product_id, quantity, unit_price, discount, gross, net (doubles),
                seller_id if the seller is recorded per line
    products    product_id, product_name, category_id, list_price [discontinued, brand, supplier_id]
    categories  category_id, category_name [description]
    customers   customer_id, customer_name [contact_name, city, country, segment, place_id]
    places      place_id, nation, region; absent if customers carry city and country
    sellers     seller_id, seller_name [first_name, last_name, title, hire_date]
    shippers    shipper_id, shipper_name; absent if the source has none
    suppliers   supplier_id, supplier_name; who delivers a product; absent if the source has none
    territories seller_id, territory_id, territory, sales_region; a seller may have several

    Columns in brackets exist where the source has them. A table may be given as a
    function, which is called when an analysis first needs the table.

    Keys of the dimension tables and of ``orders`` are unique; ``plans.quality``
    has the job that checks it. No table is assumed to be small.
    """

    def __init__(
        self,
        shared: Mapping[str, DataFrame] | None = None,
        orders_checked: bool = False,
        **tables: Table,
    ) -> None:
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}")
        self.shared = dict(shared or {})
        self.orders_checked = orders_checked
        self._tables = tables

    def with_shared(self, **frames: DataFrame) -> Star:
        """The same star with totals that are already computed, by name (one of ``SHARED``)."""
        unknown = set(frames) - set(SHARED)
        if unknown:
            raise ValueError(f"unknown totals {sorted(unknown)}; known are {SHARED}")
        return Star({**self.shared, **frames}, self.orders_checked, **self._tables)

    def with_orders_checked(self) -> Star:
        """The same star, for lines whose orders are known to exist.

        Say so only after ``quality.fk_orphans`` found none: totals by seller or
        product then skip the join with orders that would only drop orphans, and
        with it the shuffle of every line.
        """
        return Star(self.shared, True, **self._tables)

    def with_tables(self, **tables: Table) -> Star:
        """A star with other tables in place of its own, and without totals of the old ones."""
        return Star(None, self.orders_checked, **{**self._tables, **tables})

    def has(self, table: str) -> bool:
        return table in self._tables

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES or name not in self._tables:
            raise AttributeError(name)
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    @property
    def seller_on_lines(self) -> bool:
        return "seller_id" in self.lines.columns


def star_from_retail(tables: Mapping[str, DataFrame]) -> Star:
    """Star over the fourteen declared retail tables."""
    c = F.col

    def clean(column: str) -> Column:
        """A float32 as the decimal it was entered as: 9.80000019 is 9.8."""
        return as_double(c(column).cast("string"))

    gross = gross_revenue(clean("unit_price"), c("quantity"))
    return Star(
        orders=tables["orders"].select(
            "order_id",
            "customer_id",
            c("employee_id").alias("seller_id"),
            "order_date",
            c("ship_via").alias("shipper_id"),
        ),
        lines=tables["order_details"].select(
            "order_id",
            "product_id",
            c("quantity").cast("double").alias("quantity"),
            clean("unit_price").alias("unit_price"),
            clean("discount").alias("discount"),
            gross.alias("gross"),
            net_of(gross, clean("discount")).alias("net"),
        ),
        products=tables["products"].select(
            "product_id",
            "product_name",
            "category_id",
            clean("unit_price").alias("list_price"),
            c("discontinued").cast("boolean").alias("discontinued"),
            "supplier_id",
        ),
        categories=tables["categories"].select("category_id", "category_name", "description"),
        customers=tables["customers"].select(
            "customer_id",
            c("company_name").alias("customer_name"),
            "contact_name",
            "city",
            "country",
        ),
        sellers=tables["employees"].select(
            c("employee_id").alias("seller_id"),
            full_name(c("first_name"), c("last_name")).alias("seller_name"),
            "first_name",
            "last_name",
            "title",
            "hire_date",
        ),
        shippers=tables["shippers"].select("shipper_id", c("company_name").alias("shipper_name")),
        suppliers=tables["suppliers"].select("supplier_id", c("company_name").alias("supplier_name")),
        territories=lambda: (
            tables["employee_territories"]
            .join(tables["territories"], "territory_id")
            .join(tables["region"], "region_id")
            .select(
                c("employee_id").alias("seller_id"),
                "territory_id",
                F.rtrim("territory_description").alias("territory"),
                F.rtrim("region_description").alias("sales_region"),
            )
        ),
    )


def read_wholesale(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The wholesale tables, one ``<name>.parquet`` each, with declared schemas."""
    return {name: _read_wholesale(spark, root, name) for name in WHOLESALE}


def _read_wholesale(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(WHOLESALE[name].schema).parquet(f"{root}/{name}.parquet")


def star_from_parquet(spark: SparkSession, root: str) -> Star:
    """Star over the wholesale tables (``orders``, ``lineitem``, ``part``, ...).

    There the line already carries price times quantity, the seller is the
    line's supplier, the part type is the category, a customer's place is its
    nation and region, and a seller's territory is the supplier's nation.
    """
    c = F.col

    def read(name: str) -> DataFrame:
        return _read_wholesale(spark, root, name)

    def orders() -> DataFrame:
        return read("orders").selectExpr(
            "o_orderkey AS order_id", "o_custkey AS customer_id", "CAST(o_orderdate AS DATE) AS order_date"
        )

    def lines() -> DataFrame:
        return read("lineitem").select(
            c("l_orderkey").alias("order_id"),
            c("l_partkey").alias("product_id"),
            c("l_suppkey").alias("seller_id"),
            c("l_quantity").alias("quantity"),
            F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
            c("l_discount").alias("discount"),
            c("l_extendedprice").alias("gross"),
            net_of(c("l_extendedprice"), c("l_discount")).alias("net"),
        )

    def products() -> DataFrame:
        return read("part").selectExpr(
            "p_partkey AS product_id",
            "p_name AS product_name",
            "p_type AS category_id",
            "p_retailprice AS list_price",
            "p_brand AS brand",
        )

    def categories() -> DataFrame:
        types = read("part").filter("p_type IS NOT NULL")
        return types.selectExpr("p_type AS category_id", "p_type AS category_name").distinct()

    def customers() -> DataFrame:
        return read("customer").selectExpr(
            "c_custkey AS customer_id",
            "c_name AS customer_name",
            "c_mktsegment AS segment",
            "c_nationkey AS place_id",
        )

    def places() -> DataFrame:
        joined = read("nation").join(read("region"), c("n_regionkey") == c("r_regionkey"))
        return joined.selectExpr("n_nationkey AS place_id", "n_name AS nation", "r_name AS region")

    def sellers() -> DataFrame:
        return read("supplier").selectExpr("s_suppkey AS seller_id", "s_name AS seller_name")

    def territories() -> DataFrame:
        return read("supplier").join(places(), c("s_nationkey") == c("place_id")).selectExpr(
            "s_suppkey AS seller_id", "place_id AS territory_id", "nation AS territory", "region AS sales_region"
        )

    return Star(
        orders=orders,
        lines=lines,
        products=products,
        categories=categories,
        customers=customers,
        places=places,
        sellers=sellers,
        territories=territories,
    )
