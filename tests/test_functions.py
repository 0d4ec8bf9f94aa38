from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlet.functions import (
    above_average,
    above_average_badge,
    currency_label,
    exact_sum,
    full_name,
    gross_revenue,
    growth_direction,
    money,
    month_label,
    net_revenue,
    percent_label,
    percent_of,
    rank_tier,
    signed_percent_label,
)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_revenue_widens_before_multiplying_in_either_ansi_mode(spark):
    df = spark.createDataFrame([(9.8, 10, 0.15)], "p float, q short, d float")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        got = df.select(
            money(net_revenue(F.col("p"), F.col("q"), F.col("d"))).alias("net"),
            money(gross_revenue(F.col("p"), F.col("q"))).alias("gross"),
        ).first()
        assert round(got["net"], 4) == Decimal("83.3000")
        assert round(got["gross"], 4) == Decimal("98.0000")
    spark.conf.set("spark.sql.ansi.enabled", "true")


@pytest.mark.parametrize("scale", [2, 4, 8])
def test_exact_sum_equals_decimal_arithmetic(spark, scale):
    rng = random.Random(7)
    values = [rng.randrange(-(10**13), 10**13) / 10**scale for _ in range(2000)]
    # Values with more digits than a double holds are left to the double's own value.
    exact = sum(Decimal(round(v * 10**scale)) for v in values).scaleb(-scale)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    assert df.agg(exact_sum("v", scale)).first()[0] == exact


def test_exact_sum_does_not_depend_on_partitioning(spark):
    df = spark.range(50_000).select((F.rand(3) * 1e6).cast("decimal(18,4)").cast("double").alias("v"))
    df = spark.createDataFrame(df.toPandas())
    sums = {df.repartition(n).agg(exact_sum("v")).first()[0] for n in (1, 3, 11)}
    assert len(sums) == 1


def test_exact_sum_of_nothing_is_null_and_nulls_are_skipped(spark):
    df = spark.createDataFrame([(1, None), (2, 1.5), (2, None), (3, -0.0001)], "k int, v double")
    got = dict(df.groupBy("k").agg(exact_sum("v")).collect())
    assert got == {1: None, 2: Decimal("1.5000"), 3: Decimal("-0.0001")}
    assert df.filter("false").agg(exact_sum("v")).first()[0] is None


def test_percent_of_zero_total_is_null(spark):
    assert one(spark, percent_of(F.col("a"), F.col("b")), a=1.0, b=0.0) is None
    assert one(spark, percent_of(F.col("a"), F.col("b")), a=1.0, b=4.0) == 25.0


@pytest.mark.parametrize("value,label", [(2.0, "Above Average"), (1.0, "Below Average"), (0.5, "Below Average")])
def test_equal_to_average_counts_as_below(spark, value, label):
    assert one(spark, above_average(F.col("v"), F.lit(1.0)), v=value) == label


def test_null_counts_as_below(spark):
    got = spark.sql("select cast(null as double) v").select(above_average(F.col("v"), F.lit(1.0))).first()[0]
    assert got == "Below Average"


def test_tiers_and_badges(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "r int")
    tiers = [t[0] for t in df.orderBy("r").select(rank_tier(F.col("r"))).collect()]
    assert tiers == ["green"] * 3 + ["amber"] * 2 + ["red"] * 2
    assert one(spark, above_average_badge(F.col("c")), c="Above Average") == "green"
    assert one(spark, above_average_badge(F.col("c")), c="Below Average") == "amber"
    assert [one(spark, growth_direction(F.col("g")), g=g) for g in (0.0, 2.0, -0.1)] == ["up", "up", "down"]


def test_name_with_a_missing_part_is_null(spark):
    df = spark.createDataFrame([("Ann", "Lee"), (None, "Lee")], "f string, l string")
    assert [r[0] for r in df.select(full_name(F.col("f"), F.col("l"))).collect()] == ["Ann Lee", None]


def test_display_texts(spark):
    assert one(spark, currency_label(F.col("v")), v=1265793.4) == "$1,265,793"
    assert one(spark, percent_label(F.col("v")), v=21.27) == "21.3%"
    assert one(spark, signed_percent_label(F.col("v")), v=1.25) in ("+1.3%", "+1.2%")
    assert one(spark, signed_percent_label(F.col("v")), v=-85.18) == "-85.2%"
    missing = spark.sql("select cast(null as double) v").select(signed_percent_label(F.col("v"))).first()[0]
    assert missing == "N/A"
    assert one(spark, month_label(F.col("d").cast("date")), d="1998-05-01") == "May 1998"
