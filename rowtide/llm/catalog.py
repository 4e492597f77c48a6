"""Registry of the queries of this subpackage, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowtide.plans.catalog import Query, Run

CATALOG: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        CATALOG[run.__name__] = Query(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the named columns, so that the scan reads no others."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
