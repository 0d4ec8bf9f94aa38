from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from sales_rows import final_plan, order, rows
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from martlet import sources
from martlet.session import SETTINGS, clear_scratch, materialise, scratch_dir, shuffle_partitions
from martlet.sources.jdbc import jdbc_options
from martlet.sources.schemas import FOREIGN_KEYS, OPTIONAL, REQUIRED, RETAIL, WHOLESALE, table_spec

# Own sample lines with the shapes a dump can hold.
DUMP = r"""
SET standard_conforming_strings = on;
CREATE TABLE categories (
    category_id smallint NOT NULL
);
INSERT INTO categories VALUES (1, 'Teas, dried', 'Leaf (loose), bag; and ''mixed''', '\x');
INSERT INTO categories VALUES (2, 'Null', 'NULL', '\x00ff');
INSERT INTO public.categories VALUES (3, '', NULL, NULL);
INSERT INTO order_details VALUES (1, 7, 9.80000019, 10, 0.150000006);
INSERT INTO order_details VALUES (1, 8, -1.5, 1, 0);
INSERT INTO orders VALUES (1, 'ABCDE', 5, '1996-07-04', NULL, NULL, 3, 32.5, 'Rue de l''Est (2)', 'C:\dir\n', 'München', NULL, '51100', 'France');
"""


@pytest.fixture
def dump(tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text(DUMP, encoding="utf-8")
    return str(path)


def check_loaded(tables):
    assert sorted(rows(tables["categories"])) == [
        (1, "Teas, dried", "Leaf (loose), bag; and 'mixed'", bytearray()),
        (2, "Null", "NULL", bytearray(b"\x00\xff")),
        (3, "", None, None),
    ]
    lines = sorted(rows(tables["order_details"], "product_id", "quantity", "discount"))
    assert [(p, q) for p, q, _ in lines] == [(7, 10), (8, 1)]
    found = tables["orders"].first()
    assert found["order_date"] == dt.date(1996, 7, 4) and found["required_date"] is None
    assert found["ship_name"] == "Rue de l'Est (2)" and found["ship_address"] == "C:\\dir\\n"
    assert found["ship_city"] == "München" and found["ship_region"] is None
    assert tables["shippers"].count() == 0


@pytest.mark.parametrize("partitions", [2, 100])
def test_a_database_is_not_cut_without_a_key(partitions):
    with pytest.raises(ValueError, match="needs a key"):
        jdbc_options("jdbc:x", "t", partitions=partitions)


def test_sql_text_over_given_tables_leaves_views_alone(spark, tables):
    spark.range(7).createOrReplaceTempView("orders")
    built = tables(orders=[order(1, "1997-01-05"), order(2, "1997-01-06")])
    text = "SELECT COUNT(*) AS n FROM {orders} WHERE order_id > :k"
    assert sources.run_query(spark, text, {"k": 1}, {"orders": built["orders"]}).first()["n"] == 1
    assert spark.table("orders").count() == 7
    spark.catalog.dropTempView("orders")


def test_dump_is_read_with_declared_types(spark, dump):
    tables = sources.read_dump(spark, dump)
    assert {n: [f.dataType for f in t.schema] for n, t in tables.items()} == {
        n: [f.dataType for f in s.schema] for n, s in RETAIL.items()
    }
    check_loaded(tables)


def test_dump_converts_to_one_folder_per_table(spark, dump, tmp_path):
    sources.convert_dump(spark, dump, str(tmp_path / "out"))
    check_loaded(sources.read_tables(spark, str(tmp_path / "out")))


@pytest.mark.parametrize(
    "statement",
    [
        "INSERT INTO shippers VALUES (1, 'too few');",
        "INSERT INTO shippers VALUES (99999, 'out of range', NULL);",
    ],
)
def test_unreadable_statement_fails_the_load(spark, tmp_path, statement):
    path = tmp_path / "bad.sql"
    path.write_text(statement + "\n")
    with pytest.raises(PySparkException):
        sources.read_dump(spark, str(path))["shippers"].collect()


def test_long_text_literal(spark, tmp_path):
    path = tmp_path / "long.sql"
    path.write_text("INSERT INTO shippers VALUES (1, '" + "it''s " * 40_000 + "', NULL);\n")
    name = sources.read_dump(spark, str(path))["shippers"].first()["company_name"]
    assert name == "it's " * 40_000


def test_declared_schemas():
    assert len(RETAIL) == 14 and len(FOREIGN_KEYS) == 13
    assert all(s.primary_key for s in RETAIL.values())
    assert all(set(s.primary_key) <= set(s.not_null) for s in RETAIL.values())
    assert RETAIL["customers"].max_length["company_name"] == 40
    assert RETAIL["orders"].schema["freight"].dataType == T.FloatType()
    spec = table_spec(
        "t",
        [("a", "long", None, REQUIRED), ("b", "string", 3, OPTIONAL), ("c", "string", None, OPTIONAL)],
        ("a",),
    )
    assert spec.not_null == ("a",) and spec.max_length == {"b": 3} and len(spec.schema) == 3
    assert set(WHOLESALE) == {"region", "nation", "customer", "supplier", "part", "orders", "lineitem"}


def test_sql_text_with_parameters(spark, tables):
    built = tables(shippers=[{"shipper_id": 1, "company_name": "A"}, {"shipper_id": 2, "company_name": "B"}])
    sources.register_views({"shippers": built["shippers"]})
    got = sources.run_query(spark, "SELECT company_name AS n FROM shippers WHERE shipper_id > :k", {"k": 1})
    assert got.columns == ["n"] and rows(got) == [("B",)]
    assert sources.run_query(spark, "SELECT COUNT(*) AS n FROM shippers").first()["n"] == 2


def test_sql_text_written_for_a_database(spark, tables):
    quarters = ["1997-01-05", "1997-02-07", "1997-05-01"]
    built = tables(orders=[{**order(i, d), "ship_country": "Peru"} for i, d in enumerate(quarters)])
    sources.register_views({"orders": built["orders"]})
    got = sources.run_query(
        spark,
        """
        SELECT o.ship_country AS "Ship Country", DATE_TRUNC('quarter', o.order_date)::date AS "Quarter",
               COUNT(*) AS "Orders"
        FROM orders o GROUP BY 1, 2 HAVING COUNT(*) > 1
        """,
    )
    assert got.columns == ["Ship Country", "Quarter", "Orders"]
    assert rows(got) == [("Peru", dt.date(1997, 1, 1), 2)]


def test_catalogue_lists_tables_and_views(spark):
    spark.range(1).write.mode("overwrite").saveAsTable("listed_table")
    spark.range(1).createOrReplaceTempView("listed_view")
    listed = dict(rows(sources.list_tables(spark)))
    assert listed["listed_table"] == "BASE TABLE" and listed["listed_view"] == "VIEW"


def test_preview_is_repeatable(spark):
    df = spark.range(100).repartition(7)
    assert rows(sources.preview(df, "id")) == [(0,), (1,), (2,), (3,), (4,)]
    assert rows(sources.preview(df, ["id"], 2)) == [(0,), (1,)]


def test_database_read_is_split_by_key():
    options = jdbc_options("jdbc:postgresql://db/x", "orders", "order_id", 1, 1000, 8, properties={"user": "u"})
    assert options["partitionColumn"] == "order_id" and options["numPartitions"] == "8"
    assert options["user"] == "u" and options["dbtable"] == "orders"
    assert "partitionColumn" not in jdbc_options("jdbc:x", "orders")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "orders", "order_id")


def test_bucketed_tables_join_without_an_exchange(spark):
    facts = spark.range(3000).selectExpr("id % 1000 AS order_id", "id AS amount")
    sources.write_bucketed(facts, "bucketed_lines", "order_id", 4)
    sources.write_bucketed(spark.range(1000).withColumnRenamed("id", "order_id"), "bucketed_orders", "order_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_orders").join(
            spark.table("bucketed_lines").groupBy("order_id").sum("amount"), "order_id"
        )
        assert "Exchange" not in final_plan(joined)
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", SETTINGS["spark.sql.autoBroadcastJoinThreshold"])


def test_partitioned_write_keeps_all_rows(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "IF(id < 700, 1, id % 5) AS k")
    sources.write_table(df, str(tmp_path / "t"), ["k"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 1000 and back.filter("k = 1").count() == df.filter("k = 1").count()


def test_intermediate_tables_go_to_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark).startswith(shared)
    written = materialise(spark.range(5), "check")
    assert written.inputFiles()[0].removeprefix("file://").startswith(shared)
    assert written.count() == 5
    folder = Path(scratch_dir(spark))
    assert folder.exists()
    clear_scratch(spark)
    assert not folder.exists() and Path(shared).exists()


def test_a_session_without_a_shared_folder_gets_an_error():
    class Bare:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError):
        scratch_dir(Bare())


_SHIPPER = "VALUES (%s, 'Ship', NULL);"


def test_inserts_in_any_case_and_indentation_are_loaded(spark, tmp_path):
    path = tmp_path / "d.sql"
    path.write_text(
        f"insert into shippers {_SHIPPER % 1}\n  INSERT INTO shippers {_SHIPPER % 2}\n"
        f"INSERT INTO public.SHIPPERS {_SHIPPER % 3}\n-- INSERT in a comment\n"
    )
    assert sorted(rows(sources.read_dump(spark, str(path))["shippers"], "shipper_id")) == [(1,), (2,), (3,)]
    loaded = sources.convert_dump(spark, str(path), str(tmp_path / "out"))
    assert loaded["shippers"] == 3 and sum(loaded.values()) == 3
    assert not (tmp_path / "out" / "_statements").exists()


@pytest.mark.parametrize("line", ["INSERT INTO nowhere VALUES (1);", "COPY shippers (shipper_id) FROM stdin;", "insert into shippers"])
def test_what_cannot_be_loaded_fails_the_job(spark, tmp_path, line):
    path = tmp_path / "d.sql"
    path.write_text(f"INSERT INTO shippers {_SHIPPER % 1}\n{line}\n")
    with pytest.raises(Exception, match="unreadable INSERT or undeclared table"):
        sources.convert_dump(spark, str(path), str(tmp_path / "out"))


def test_shuffle_partitions_follow_the_data():
    assert shuffle_partitions(0) == 8
    assert shuffle_partitions(10 * 1024**4) == 52429
