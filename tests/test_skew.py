"""A third of the rows under one key, ties and nulls: the block path against SQL."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rowtide.operators.aggregates import exact_percentiles
from rowtide.operators.joins import as_of_join, count_in_range
from rowtide.operators.ordered import SAFE_GROUP_ROWS_SETTING, Order, order_groups
from rowtide.plans import CATALOG
from tests.compare import assert_same, counted, duck

SF_DIR = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def any_size_is_large(spark):
    spark.conf.set(SAFE_GROUP_ROWS_SETTING, "0")
    yield
    spark.conf.unset(SAFE_GROUP_ROWS_SETTING)


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    """The tables with one user, customer and order holding a third of the rows each."""
    folder = tmp_path_factory.mktemp("skewed")
    changes = {
        "events": ("event_id", "user_id"),
        "orders": ("o_orderkey", "o_custkey"),
        "lineitem": ("l_partkey", "l_orderkey"),
    }
    for name in ("region", "nation", "customer", "supplier", "part", *changes):
        df = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        if name in changes:
            row, key = changes[name]
            df = df.withColumn(key, F.when(F.col(row) % 3 == 0, 7).otherwise(F.col(key)))
        # DuckDB and the stream reader look for one file per table.
        df.toPandas().to_parquet(folder / f"{name}.parquet", coerce_timestamps="us", index=False)
    return str(folder)


SKEWED = [n for n, q in CATALOG.items() if q.run.__module__.rsplit(".", 1)[1] in ("ordered", "streams")]
SKEWED += ["left_join_line_counts", "semi_join_returned_orders", "exact_price_percentiles",
           "star_join_revenue", "top_orders_per_customer", "value_at_extreme"]


@pytest.mark.parametrize("name", SKEWED)
def test_hot_key_matches_sql(spark, any_size_is_large, skewed_dir, name):
    assert_same(CATALOG[name].run(spark, skewed_dir), duck(skewed_dir), CATALOG[name].sql)


def _awkward(spark):
    """Half of the rows in one group, half of that group at one value, and nulls."""
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    row = F.col("o_orderkey")
    return orders.select(
        row.alias("id"),
        F.when(row % 2 == 0, 1).when(row % 7 != 0, row % 5 + 2).alias("key"),
        F.when(row % 11 == 0, None).when(row % 4 == 0, 5.0).when(row % 13 == 0, float("nan"))
        .otherwise(F.round("o_totalprice", -3)).alias("value"),
        F.when(row % 3 != 0, row).alias("amount"),
    )


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_blocks_equal_plain_windows(spark, keys, descending):
    def run(safe):
        spark.conf.set(SAFE_GROUP_ROWS_SETTING, safe)
        groups = order_groups(_awkward(spark), keys, Order("value", descending, "id"))
        assert groups.split == (safe == "0")
        groups = groups.ranks(tiles=7).running_sum("amount", "upto")
        groups = groups.previous("amount", "before").following("amount", "after")
        result = groups.last_known("amount", "known").result()
        return counted(result.collect())

    try:
        assert run("0") == run("1000000000")
    finally:
        spark.conf.unset(SAFE_GROUP_ROWS_SETTING)


def test_no_block_holds_much_more_than_its_share(spark, any_size_is_large):
    rows = _awkward(spark)
    groups = order_groups(rows, ["key"], Order("value", tiebreak="id"))
    sizes = groups.df.where("_block is not null").groupBy("key", "_block", "_sub").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1.5 * rows.count() / 8


@pytest.mark.parametrize("values", [4, 8, 32])
def test_frequent_values_are_cut_by_their_own_ties(spark, any_size_is_large, values):
    rows = spark.range(16_000).select(
        F.lit(1).alias("key"), F.expr(f"id div {16_000 // values}").alias("value"), "id"
    )
    groups = order_groups(rows, ["key"], Order("value", tiebreak="id"))
    sizes = groups.df.groupBy("_block", "_sub").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1.5 * 16_000 / 32


@pytest.mark.parametrize("safe", ["0", "1000000000"])
def test_descending_order_is_that_of_a_window(spark, safe):
    spark.conf.set(SAFE_GROUP_ROWS_SETTING, safe)
    try:
        least, numbers = -(1 << 63), [1.5, None, float("nan"), float("-inf"), 2.5]
        rows = spark.createDataFrame(
            [(1, i, least + i % 3, numbers[i % 5], date(2024, 1, 1 + i % 4)) for i in range(60)],
            "key int, id bigint, whole bigint, number double, day date",
        )
        for column in ("whole", "number", "day"):
            order = Window.partitionBy("key").orderBy(F.desc(column))
            ranked = order_groups(rows, ["key"], Order(column, True, "id")).ranks().result()
            expected = rows.select("id", F.rank().over(order).alias("rank"))
            assert sorted(ranked.select("id", "rank").collect()) == sorted(expected.collect())
    finally:
        spark.conf.unset(SAFE_GROUP_ROWS_SETTING)


def test_values_that_share_a_double_keep_their_order(spark, any_size_is_large):
    big = 1 << 60
    rows = spark.range(400).select(
        F.lit(1).alias("key"), (F.lit(big) + F.col("id") % 2).alias("value"), "id"
    )
    ranked = order_groups(rows, ["key"], Order("value", tiebreak="id")).ranks().result()
    got = ranked.groupBy("value").agg(F.min("rank"), F.max("rank"), F.max("dense_rank")).collect()
    assert sorted(map(tuple, got)) == [(big, 1, 1, 1), (big + 1, 201, 201, 2)]


def test_text_cannot_order_blocks(spark):
    with pytest.raises(TypeError):
        order_groups(spark.createDataFrame([("a",)], "k string"), [], Order("k"))


def test_empty_input(spark, any_size_is_large):
    rows = _awkward(spark).where("id < 0")
    assert order_groups(rows, ["key"], Order("value")).ranks(3).result().count() == 0


TIMES = "k int, id bigint, ts timestamp_ntz"


def _times(spark, rows):
    text = spark.createDataFrame(rows, "k int, id bigint, ts string")
    return text.select("k", "id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def test_as_of_join_ties_and_nulls(spark, any_size_is_large):
    left = _times(spark, [(1, 1, "2024-01-02"), (1, 2, "2024-01-02"), (1, 3, "2024-01-01"),
                          (2, 4, "2024-01-05"), (None, 5, "2024-01-05"), (1, 6, None)])
    right = _times(spark, [(1, 10, "2024-01-02"), (1, 11, "2024-01-02"), (1, 12, "2024-01-03"),
                           (None, 13, "2024-01-04"), (1, 14, None)])
    right = right.select("k", F.col("id").alias("rid"), F.col("ts").alias("rts"))
    got = as_of_join(left, right, ["k"], "ts", "rts", ["rid"], "rid").select("id", "rid").collect()
    assert sorted(map(tuple, got)) == [(1, 11), (2, 11), (3, None), (4, None), (5, None), (6, None)]


def test_count_in_range_keeps_both_ends(spark, any_size_is_large):
    left = _times(spark, [(1, 1, "2024-01-01 10:00:00"), (1, 2, "2024-01-01 10:00:01"),
                          (1, 3, "2024-01-01 08:59:59"), (2, 4, "2024-01-01 10:00:00")])
    right = _times(spark, [(1, 5, "2024-01-01 09:00:00"), (1, 7, "2024-01-01 10:00:00")])
    right = right.select("k", F.col("id").alias("v"), F.col("ts").alias("rts"))
    got = count_in_range(left, right, ["k"], "ts", "rts", 3_600_000_000, "v")
    rows = got.select("id", "range_count", "range_sum").collect()
    assert sorted(map(tuple, rows)) == [(1, 2, 12), (2, 1, 7), (3, 0, None), (4, 0, None)]


def test_percentile_of_one_repeated_value(spark, any_size_is_large):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 600, 5).otherwise(F.col("id")).cast("decimal(15,2)").alias("v")
    )
    got = exact_percentiles(rows, [], "v", {"low": "0.3", "high": "0.75", "top": "1"}).first()
    assert got["low"] == 5 and got["high"] == Decimal("749.25") and got["top"] == 999
