"""Plan properties of every registered job: no row-at-a-time Python, no
cartesian products or nested-loop joins, filters and columns pushed into the
Parquet scans."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_shape(spark, key):
    plan = physical(QUERIES[key](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = physical(QUERIES["scan_columnar"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan


def test_date_window_is_pushed_as_a_range(spark):
    plan = physical(QUERIES["q16_price_change_sales"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


@pytest.mark.parametrize("key,column", [
    ("q07_pricey_states", "o_orderdate"), ("q12_view_then_store", "ts"), ("q17_promo_ratio", "o_orderdate"),
    ("q21_return_rebuy", "l_shipdate"), ("q23_inventory_cov", "l_shipdate"), ("join_left_semi", "o_orderdate"),
    ("join_multi_key", "o_orderdate"), ("agg_linreg", "o_orderdate"), ("q19_returned_both", "l_shipdate")])
def test_date_bounds_reach_the_reader(spark, key, column):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # the whole filter list
    plan = physical(QUERIES[key](spark, SF))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert f"GreaterThanOrEqual({column}" in plan and f"LessThan({column}" in plan


def test_text_jobs_shuffle_no_texts_to_spread_them(spark):
    for key in ("q10_sentiment", "q27_competitors", "extract_sentiment", "extract_negative", "find_company"):
        assert "RoundRobinPartitioning" not in physical(QUERIES[key](spark, SF)), key


def test_fixed_dimensions_are_broadcast(spark):
    plan = physical(QUERIES["join_dimension_broadcast"](spark, SF))
    assert "BroadcastHashJoin" in plan
