"""Streams in, and finished streams back as tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryProgress
from pyspark.sql.types import StructType

from rowtide.session import work_path
from rowtide.sources.tables import SCHEMAS


def event_stream(
    spark: SparkSession,
    folder: str,
    files: str = "events.parquet{,}",
    files_per_batch: int | None = None,
    end: str | None = None,
) -> DataFrame:
    """The event table as a stream; ``ts`` in the type watermarks need.

    ``files`` is a pattern, as a streamed path that is not one must be a folder, and a
    table may be a single file. All files there are form one batch, unless ``files_per_batch``
    asks for more batches: the watermark then moves between them, and rows that come later
    than it allows are dropped. ``end`` names the folder in which ``run_to_end`` tells the
    stream that no more rows come.
    """
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.parquet(f"{folder}/{files}")
    if end:
        events = events.union(reader.parquet(f"{end}/*.parquet"))
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


END_OF_TIME = "9999-12-31 00:00:00"

# Keeps state on local disk with a copy in the checkpoint, so it may outgrow memory.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def run_to_table(stream: DataFrame, label: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Process all input there is now, write it as a table and read that table.

    Output and checkpoint lie in the shared folder, so tasks that are lost run again
    from there. ``settings`` hold for this stream only.
    """
    path = work_path(stream.sparkSession, label)
    process(stream, path, settings)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_to_end(stream: DataFrame, label: str, end: str, settings: dict[str, str] | None = None) -> DataFrame:
    """As ``run_to_table``, with the windows that are still open when the input ends.

    Once all input is processed, one event later than any other is put into ``end``, the
    folder that ``event_stream`` was given, and the stream goes on from its checkpoint: the
    watermark passes every window but that event's own, which therefore never is a result.
    The stream is over then, as whatever comes later is late.
    """
    path = work_path(stream.sparkSession, label)
    process(stream, path, settings)
    end_stream(stream.sparkSession, end)
    process(stream, path, settings)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def end_stream(spark: SparkSession, end: str) -> None:
    """Put one event later than any other into ``end``."""
    last = {"ts": F.lit(END_OF_TIME)}
    columns = [last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMAS["events"])]
    spark.range(1).select(*columns).write.parquet(end)


def process(stream: DataFrame, path: str, settings: dict[str, str] | None = None) -> list[StreamingQueryProgress]:
    """Run the stream over the input there is now, from its checkpoint, and report its batches."""
    with _settings(stream.sparkSession, {**STATE_ON_DISK, **(settings or {})}):
        writer = stream.writeStream.outputMode("append").format("parquet")
        writer = writer.option("checkpointLocation", f"{path}/checkpoint")
        run = writer.trigger(availableNow=True).start(f"{path}/rows")
    run.awaitTermination()
    return run.recentProgress


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def one_of_each(stream: DataFrame, columns: list[str], latest_by: str) -> DataFrame:
    """Within each Arrow batch, keep one row, the latest, per value of ``columns``.

    A cheap step before a stateful operator on the same key: a flood of repeats then
    costs the task that holds the state one row per batch, not one per repeat.
    """

    def keep_latest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, [(latest_by, "descending")]))
            place = pa.array(range(batch.num_rows), pa.int64())
            numbered = pa.Table.from_batches([batch]).select(columns).append_column("_place", place)
            kept = numbered.group_by(columns).aggregate([("_place", "min")])
            yield batch.take(kept["_place_min"].combine_chunks())

    return stream.mapInArrow(keep_latest, stream.schema)
