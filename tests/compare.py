"""Compare a Spark result with DuckDB's: columns, row count and exact values."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

# DuckDB's names of types that Spark calls otherwise; the rest differ in case only.
TYPES = {"INTEGER": "int", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, Decimal):
        return value.normalize() + 0
    return value


def counted(rows) -> Counter:
    return Counter(tuple(_plain(v) for v in row) for row in rows)


def assert_same(spark_df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(spark_df.columns)
    relation = connection.sql(sql)
    assert names == sorted(relation.columns)
    assert {f.name: f.dataType.simpleString() for f in spark_df.schema} == {
        name: TYPES.get(str(kind), str(kind).lower())
        for name, kind in zip(relation.columns, relation.types)
    }
    wanted = relation.select(*[duckdb.ColumnExpression(n) for n in names])
    got, want = counted(spark_df.select(*names).collect()), counted(wanted.fetchall())
    assert sum(got.values()) == sum(want.values())
    assert got == want, list(((got - want) + (want - got)).items())[:6]
