"""Sessions for local runs, and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, app: str = "rowtide") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def work_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder that the cluster names for checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_folder(spark.sparkContext.master)
    return f"{base.rstrip('/')}/rowtide/{label}-{uuid.uuid4().hex}"


@cache
def _local_folder(master: str) -> str:
    """Where nothing is named: a machine-local folder, if all tasks run on this machine."""
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="rowtide-")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder: computed once, of known size."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
