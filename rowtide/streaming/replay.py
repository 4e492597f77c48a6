"""A stream fed arrival by arrival, with the rows that came too late beside its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.session import work_path
from rowtide.streaming.events import totals_in, window_totals
from rowtide.streaming.sources import END_OF_TIME, end_stream, event_stream, process


def replayed_totals(events: DataFrame, arrival: str, keys: list[str], window: Column, delay: str) -> DataFrame:
    """Count and sum of ``value`` per key and window, of rows in time and, apart, of late ones.

    ``arrival`` is a column of ``events`` that says when a row comes; rows of equal arrivals come
    together, earlier ones first, and between them the watermark moves on: to the latest time there
    was, less ``delay``. The stream drops a row from a window that ended by then. Those pairs of a row
    and a window are taken from the arrivals by the watermark that the stream reports for each.
    ``late`` tells the two parts apart. Rows without a time or an arrival belong to neither.

    The arrivals are written once, as folders, and handed on one by one, so their number is that
    of runs of the stream; it should be a period and not a time. What is in a run is distributed.
    """
    spark = events.sparkSession
    known = events.where(F.col("ts").isNotNull() & F.col(arrival).isNotNull())
    # As text, so that the folder's name gives back what was written.
    known = known.withColumn("_arrival", F.col(arrival).cast("string"))
    staged = work_path(spark, "arrivals")
    known.drop(arrival).write.partitionBy("_arrival").parquet(staged)
    rows = spark.read.schema(known.drop(arrival).schema).parquet(staged)
    in_order = known.select(arrival, "_arrival").distinct().orderBy(arrival).collect()

    feed, end, out = (work_path(spark, label) for label in ("feed", "feed-end", "replay"))
    stream = window_totals(event_stream(spark, feed, files="*.parquet", end=end), keys, window, delay)
    watermarks: dict[str, str] = {}
    for _, name in in_order:
        rows.where(F.col("_arrival") == name).drop("_arrival").write.mode("append").parquet(feed)
        # One batch holds the arrival; one without rows may follow it and close windows.
        batches = [p for p in process(stream, out) if p["numInputRows"]]
        watermarks[name] = batches[0]["eventTime"]["watermark"].removesuffix("Z")
    end_stream(spark, end)
    process(stream, out)

    in_time = spark.read.schema(stream.schema).parquet(f"{out}/rows")
    passed = [F.when(F.col("_arrival") == name, F.lit(at).cast("timestamp_ntz")) for name, at in watermarks.items()]
    watermark = F.coalesce(*passed, F.lit(END_OF_TIME).cast("timestamp_ntz"))
    late = rows.withColumn("w", window).where(F.col("w.end").cast("timestamp_ntz") <= watermark)
    return in_time.withColumn("late", F.lit(False)).unionByName(totals_in(late, keys, F.col("w")).withColumn("late", F.lit(True)))
