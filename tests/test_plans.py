"""Physical-plan properties the scale design relies on."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cartesian_or_nested_loop_join(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["top_products_per_category", "seasonal_top_categories",
                                  "top_sellers_per_state", "second_highest_per_category",
                                  "top_companies_per_year", "best_seller_per_seller_category"])
def test_top_k_limits_before_the_shuffle(spark, name):
    p = plan(spark, name)
    assert "WindowGroupLimit" in p and "Partial" in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "never_purchased")
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in p
    assert "ReadSchema: struct<o_custkey:bigint,o_orderpriority:string>" in p


def test_a_not_b_is_one_aggregation(spark):
    p = plan(spark, "bought_a_not_b")
    assert "LeftAnti" not in p and "Except" not in p
