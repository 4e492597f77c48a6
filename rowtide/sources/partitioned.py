"""Partitioned tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Write one folder per value of ``by``.

    Rebalancing brings the rows of a value together, so that tasks do not each open a
    file in every folder, and lets adaptive execution deal a value that holds much of
    the data out to several tasks, and files, of the advisory partition size.
    """
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
