from __future__ import annotations

import random

import pytest
from sales_rows import day, final_plan, rows
from pyspark.sql import functions as F

from martlet.operators import (
    flag_above_average,
    group_share,
    ordered_prefix,
    period_change,
    rank_by,
    running_total,
    same_period_before,
    share_of_total,
    top_n_per_group,
)


def values(spark, seed, n=2000, distinct=300, nulls=0.05, hot=0.0):
    """Random values with ties, NULLs and, with ``hot``, one value held by that share of rows."""
    rng = random.Random(seed)

    def draw():
        if rng.random() < nulls:
            return None
        return 7 if rng.random() < hot else rng.randrange(-distinct, distinct)

    data = [(i, draw(), rng.choice([None, 1, 2, 5, -3])) for i in range(n)]
    return spark.createDataFrame(data, "id long, x long, v long")


# --- rank ----------------------------------------------------------------------


@pytest.mark.parametrize("method", ["rank", "dense"])
@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("hot", [0.0, 0.4])
def test_sliced_rank_equals_plain_rank(spark, method, descending, hot):
    df = values(spark, seed=11, hot=hot)
    options = {"method": method, "descending": descending}
    plain = rank_by(df, "x", "r", short_series=True, **options)
    sliced = rank_by(df, "x", "r", **options)
    assert sorted(rows(sliced, "id", "r")) == sorted(rows(plain, "id", "r"))


def test_ties_share_a_rank(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9), ("d", 1)], "k string, x int")
    got = lambda method: dict(rows(rank_by(df, "x", "r", method=method), "k", "r"))
    assert got("rank") == {"b": 1, "c": 1, "a": 3, "d": 4}
    assert got("dense") == {"b": 1, "c": 1, "a": 2, "d": 3}


def test_null_ranks_first_when_descending(spark):
    df = spark.createDataFrame([("a", 5), ("n", None)], "k string, x int")
    assert dict(rows(rank_by(df, "x", "r"), "k", "r")) == {"n": 1, "a": 2}


def test_rank_is_bigint_and_method_is_checked(spark):
    df = spark.createDataFrame([("a", 5)], "k string, x int")
    assert dict(rank_by(df, "x", "r").dtypes)["r"] == "bigint"
    assert dict(rank_by(df, "x", "r").dtypes)["r"] == "bigint"
    with pytest.raises(ValueError):
        rank_by(df, "x", method="ordinal")


def test_sliced_rank_moves_no_rows_to_one_task(spark):
    plan = final_plan(rank_by(values(spark, seed=2), "x", "r"))
    # The only single-partition steps take one row per slice, or each task's part of the cuts.
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "_slice" in part.split("\n")[1] or "partial_percentile_approx" in part.split("\n")[1]


# --- running total ---------------------------------------------------------------


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sliced_running_total_equals_plain(spark, descending, seed):
    df = values(spark, seed=seed, nulls=0.2)
    plain = running_total(df, "x", "v", descending=descending, short_series=True)
    sliced = running_total(df, "x", "v", descending=descending)
    assert sorted(rows(sliced, "id", "running_total")) == sorted(rows(plain, "id", "running_total"))


def test_sliced_running_total_over_dates_that_start_with_nulls(spark):
    data = [(day("1996-01-01"), None), (day("1996-01-02"), None), (day("1997-01-01"), 3)]
    data += [(day("1998-01-01"), None), (day("1998-06-01"), 4), (None, 9)]
    df = spark.createDataFrame(data, "d date, v long")
    want = [None, None, 3, 3, 7, 16]
    for short in (True, False):
        total = running_total(df, "d", "v", short_series=short)
        ordered = total.orderBy(F.col("d").asc_nulls_last())
        assert [r["running_total"] for r in ordered.collect()] == want


def test_running_total_of_tied_rows_is_shared_and_ends_at_the_total(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (2, 30), (3, 40)], "x int, v int")
    got = rows(running_total(df, "x", "v").orderBy("x", "v"), "running_total")
    assert got == [(10,), (60,), (60,), (100,)]


def test_prefix_columns_agree_in_every_form(spark):
    df = values(spark, seed=5, hot=0.3)
    columns = ["id", "_upto", "_tied", "_rank", "_dense_rank"]
    forms = [
        ordered_prefix(df, "x", "v", short_series=True),
        ordered_prefix(df, "x", "v"),
        ordered_prefix(df, "x", "v", slices=9),
    ]
    first, *others = [sorted(rows(f, *columns)) for f in forms]
    assert all(o == first for o in others)


def test_prefix_of_an_empty_input_is_empty(spark):
    empty = spark.createDataFrame([], "x long, v long")
    assert rank_by(empty, "x").count() == 0
    assert running_total(empty, "x", "v").count() == 0


@pytest.mark.parametrize("short", [True, False])
def test_largest_value_has_rank_1_and_totals_of_positive_values_rise(spark, short):
    df = values(spark, seed=8, nulls=0).select("id", F.abs("x").alias("x"), F.abs("v").alias("v"))
    ranked = rank_by(df, "x", "r", short_series=short)
    top = df.agg(F.max("x")).first()[0]
    assert {r["x"] for r in ranked.filter("r = 1").collect()} == {top}
    total = running_total(df, "x", "v", short_series=short).orderBy("x")
    series = [r["running_total"] for r in total.collect() if r["running_total"] is not None]
    assert series == sorted(series) and series[-1] == df.agg(F.sum("v")).first()[0]


# --- top n ---------------------------------------------------------------------


def test_top_n_breaks_ties_by_key_and_keeps_null_group(spark):
    data = [("a", 1, 5), ("a", 2, 5), ("a", 3, 9), ("a", 4, 1), (None, 5, 2)]
    df = spark.createDataFrame(data, "g string, k int, x int")
    top = top_n_per_group(df, "g", "x", "k", 2)
    assert sorted(rows(top, "k", "rn")) == [(1, 2), (3, 1), (5, 1)]


def test_top_n_limits_groups_before_the_shuffle(spark):
    df = spark.range(10_000).select((F.col("id") % 3).alias("g"), "id", F.hash("id").alias("x"))
    plan = final_plan(top_n_per_group(df, "g", "x", "id", 3))
    before_shuffle = plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


# --- shares and flags --------------------------------------------------------------


@pytest.mark.parametrize("seed", [4, 5])
def test_shares_add_up_to_100(spark, seed):
    df = values(spark, seed=seed, nulls=0).select("id", F.abs("x").alias("x"))
    assert share_of_total(df, "x", "p").agg(F.sum("p")).first()[0] == pytest.approx(100)


def test_share_of_a_zero_total_is_null(spark):
    df = spark.createDataFrame([(5,), (-5,)], "x int")
    assert rows(share_of_total(df, "x", "p"), "p") == [(None,), (None,)]


def test_share_keeps_rows_distributed(spark):
    plan = final_plan(share_of_total(values(spark, seed=3), "x", "p"))
    main, subquery = plan.split("Subquery", 1)
    assert "SinglePartition" not in main
    assert "partial_sum" in subquery


def test_group_share_keeps_the_null_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 2)], "g string, x int")
    assert sorted(rows(group_share(df, "g", "x", "p"), "x", "p")) == [(1, 25.0), (2, 100.0), (3, 75.0)]


def test_flag_is_strict(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    got = dict(rows(flag_above_average(df, "x"), "x", "value_category"))
    assert got == {1.0: "Below Average", 2.0: "Below Average", 3.0: "Above Average", None: "Below Average"}


# --- growth ----------------------------------------------------------------------


def series(spark, *pairs):
    return spark.createDataFrame([(day(d) if d else None, v) for d, v in pairs], "month date, total long")


def growth(df, **options):
    change = period_change(df, ["month"], "total", "g", **options)
    return [r["g"] for r in change.orderBy(F.col("month").asc_nulls_last()).collect()]


def test_first_month_has_no_growth(spark):
    assert growth(series(spark, ("1996-07-01", 10))) == [None]
    assert growth(series(spark, ("1996-07-01", 10), ("1996-08-01", 15))) == [None, 50.0]


def test_zero_month_has_no_growth_after_it_under_either_guard(spark):
    df = series(spark, ("1996-07-01", 0), ("1996-08-01", 15))
    assert growth(df, guard="positive") == [None, None]
    assert growth(df, guard="nonzero") == [None, None]


def test_negative_month_only_blocks_the_positive_guard(spark):
    df = series(spark, ("1996-07-01", -10), ("1996-08-01", 15))
    assert growth(df, guard="positive") == [None, None]
    assert growth(df, guard="nonzero") == [None, -250.0]


def test_missing_month_is_skipped_unless_the_calendar_counts(spark):
    df = series(spark, ("1997-01-01", 10), ("1997-03-01", 15), ("1997-04-01", 30))
    assert growth(df) == [None, 50.0, 100.0]
    assert growth(df, calendar=True) == [None, None, 100.0]


def test_unknown_guard_is_refused(spark):
    with pytest.raises(ValueError):
        period_change(series(spark, ("1997-01-01", 1)), ["month"], "total", guard="none")


def test_same_month_of_the_year_before(spark):
    df = series(spark, ("1996-01-01", 1), ("1996-12-01", 2), ("1997-01-01", 3), ("1998-12-01", 4))
    got = df.withColumn("y", same_period_before("total", "month", 12)).orderBy("month")
    assert rows(got, "y") == [(None,), (None,), (1,), (None,)]
