"""Functions, sources, set operations and the driver contract on small rows."""

import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from rowtide.functions.calendar import business_days, instalments
from rowtide.functions.columns import cents, exact_sum, micros, timestamp_from_micros
from rowtide.operators.ordered import Order, order_groups
from rowtide.operators.aggregates import histogram
from rowtide.session import _local_folder, work_path
from rowtide.sources.partitioned import read_partitioned, write_partitioned
from rowtide.sources.tables import SCHEMAS, read_table


def test_entry_and_catalog_agree(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", SCHEMAS)
def test_declared_schema_is_the_files_schema(spark, name):
    found = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").schema
    declared = read_table(spark, "/root/testdata/sf0.001", name).schema
    assert [(f.name, f.dataType) for f in declared] == [(f.name, f.dataType) for f in found]


def test_exact_sum_of_large_negative_and_null(spark):
    values = [(1 << 62) - 1] * 3 + [-5, None, -(1 << 40)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    total = df.agg(exact_sum(F.col("v"), 4).alias("s")).first()["s"]
    assert total == Decimal(sum(v for v in values if v is not None)).scaleb(-4)
    assert df.where("v is null").agg(exact_sum(F.col("v"), 4).alias("s")).first()["s"] is None


def test_cents_of_awkward_doubles(spark):
    df = spark.createDataFrame([(1.15,), (2.675,), (-0.29,), (1e9 + 0.07,), (None,)], "v double")
    assert [r[0] for r in df.select(cents("v")).collect()] == [115, 268, -29, 100000000007, None]


def test_micros_round_trip(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-30 23:57:12.194062' ts")
    row = df.select("ts", timestamp_from_micros(micros("ts")).alias("back")).first()
    assert row["ts"] == row["back"]


def test_business_days(spark):
    df = spark.sql("""
        SELECT * FROM VALUES (date'2024-01-05', date'2024-01-08'), (date'2024-01-08', date'2024-01-05'),
            (date'2024-01-06', date'2024-01-08'), (NULL, date'2024-01-08') AS t(a, b)
    """)
    assert [r[0] for r in df.select(business_days(F.col("a"), F.col("b"))).collect()] == [1, -1, 0, None]


def test_instalments_add_up(spark):
    asked = spark.createDataFrame([(1, 100, 3), (2, 7, 1), (3, 5, 0)], "id long, cents long, parts int")
    rows = instalments(asked).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, 34), (1, 2, 33), (1, 3, 33), (2, 1, 7)]


def test_histogram_clips_and_skips_nulls(spark):
    df = spark.createDataFrame([("a", -3.0), ("a", 0.5), ("a", 99.0), ("b", None), (None, 1.0)], "k string, v double")
    got = sorted(map(str, histogram(df, ["k"], "v", 0.0, 1.0, 3).collect()))
    assert got == sorted(["Row(k='a', bin=0, n=2)", "Row(k='a', bin=2, n=1)", "Row(k=None, bin=1, n=1)"])


def test_running_sum_refuses_floating_point(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "k int, o int, v double")
    with pytest.raises(TypeError):
        order_groups(df, ["k"], Order("o")).running_sum("v", "s")


def test_instalments_and_histogram_skip_missing_values(spark):
    asked = spark.createDataFrame([(1, None, 3), (2, 7, None), (None, 5, 1)], "id long, cents long, parts int")
    assert [tuple(r) for r in instalments(asked).collect()] == [(None, 1, 5)]
    df = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),)], "v double")
    assert [tuple(r) for r in histogram(df, [], "v", 0.0, 1.0, 3).collect()] == [(2, 1)]


def test_partitioned_table_spreads_a_large_value(spark):
    path = work_path(spark, "spread")
    rows = spark.range(0, 100_000, numPartitions=16).select("id", F.lit("x").alias("kind"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100kb")
    try:
        write_partitioned(rows, path, ["kind"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = read_partitioned(spark, path, "id bigint, kind string")
    assert back.distinct().count() == back.count() == 100_000
    assert back.select(F.input_file_name()).distinct().count() > 1


def test_work_path_lies_in_the_named_folder(spark):
    first, second = work_path(spark, "a"), work_path(spark, "a")
    assert first != second
    assert first.startswith(spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir())


def test_a_cluster_must_name_its_folder():
    assert _local_folder("local[8]").startswith(tempfile.gettempdir())
    with pytest.raises(RuntimeError):
        _local_folder("spark://host:7077")
