"""What Spark plans: pruned scans, partial aggregates, no products of two tables."""

import pytest
from pyspark.sql import functions as F

from rowtide.plans import CATALOG

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = [n for n, q in CATALOG.items() if not q.run.__module__.endswith("streams")]


@pytest.mark.parametrize("name", BATCH)
def test_no_products_and_no_row_at_a_time_python(spark, name):
    plan = plan_of(CATALOG[name].run(spark, SF_DIR))
    for operator in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
        assert operator not in plan


def test_filter_and_columns_reach_the_scan(spark):
    plan = plan_of(CATALOG["pricing_summary"].run(spark, SF_DIR))
    assert "LessThanOrEqual(l_shipdate,2000-09-02T00:00)" in plan
    assert "l_orderkey" not in plan and "l_partkey" not in plan


def test_partition_filter_prunes_folders(spark):
    plan = plan_of(CATALOG["partitioned_write_pruned_read"].run(spark, SF_DIR))
    assert "PartitionFilters: [isnotnull(l_returnflag" in plan


def test_top_rows_are_kept_before_the_shuffle(spark):
    assert plan_of(CATALOG["top_orders_per_customer"].run(spark, SF_DIR)).count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_of(CATALOG["top_orders"].run(spark, SF_DIR))


@pytest.mark.parametrize(
    "name, shuffles",
    [("rank_orders", 1), ("neighbouring_events", 1), ("user_sessions", 2),
     ("as_of_join_latest_view", 1), ("trailing_week_revenue", 2), ("cube_totals", 2)],
)
def test_number_of_shuffles(spark, name, shuffles):
    plan = plan_of(CATALOG[name].run(spark, SF_DIR))
    assert plan.count("Exchange hashpartitioning") <= shuffles


def test_joins_shuffle_when_no_side_is_small(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("star_join_revenue", "lookup_join_region", "range_join_views_before_purchase"):
            plan = plan_of(CATALOG[name].run(spark, SF_DIR))
            assert "Broadcast" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_groups_are_cut_without_a_second_shuffle_of_their_rows(spark):
    spark.conf.set("rowtide.safeGroupRows", "0")
    try:
        plan = plan_of(CATALOG["running_spend_overall"].run(spark, SF_DIR))
    finally:
        spark.conf.unset("rowtide.safeGroupRows")
    assert "Exchange SinglePartition" not in plan
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan
