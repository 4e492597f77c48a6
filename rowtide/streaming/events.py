"""Event-time operators on the event stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.functions.columns import money
from rowtide.streaming.sources import one_of_each

# Merges sessions inside each input partition before the shuffle.
LOCAL_SESSIONS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def window_totals(stream: DataFrame, keys: list[str], window: Column, delay: str) -> DataFrame:
    """Count and sum of ``value`` per key and event-time window, once the window closes."""
    return totals_in(stream.withWatermark("ts", delay), keys, window)


def totals_in(rows: DataFrame, keys: list[str], window: Column) -> DataFrame:
    """Count and sum of ``value`` per key and window."""
    totals = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(money("value")).cast("decimal(38,2)").alias("total"))
    return totals.select(
        *keys,
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "n",
        "total",
    )


def followed_by(
    stream: DataFrame, first: str, second: str, within: timedelta, delay: str
) -> DataFrame:
    """Pairs of one user's ``first`` event and a ``second`` event at most ``within`` later.

    Events meet by user and by a bucket of time as wide as ``within``: a ``first`` event is
    kept under its own bucket and the next one, a ``second`` one under its own. The state of
    a busy user is thus spread over time, in two copies whatever the cluster. Events
    without a user or a time meet nothing.
    """
    stream = stream.select("event_id", "ts", "user_id", "event_type").withWatermark("ts", delay)
    width = max(within // timedelta(microseconds=1), 1)

    def bucket(ts: str) -> Column:
        return F.expr(f"(unix_micros({ts}) - pmod(unix_micros({ts}), {width})) div {width}")

    earlier = stream.where((F.col("event_type") == first) & F.col("ts").isNotNull()).select(
        F.col("user_id"),
        F.col("event_id").alias("first_id"),
        F.col("ts").alias("first_ts"),
        F.explode(F.array(bucket("ts"), bucket("ts") + 1)).alias("bucket"),
    )
    later = stream.where((F.col("event_type") == second) & F.col("ts").isNotNull()).select(
        F.col("user_id").alias("second_user"),
        F.col("event_id").alias("second_id"),
        F.col("ts").alias("second_ts"),
        bucket("ts").alias("second_bucket"),
    )
    near = (F.col("second_ts") >= F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.lit(within))
    same = (F.col("user_id") == F.col("second_user")) & (F.col("bucket") == F.col("second_bucket"))
    return earlier.join(later, same & near, "inner").select(
        "user_id",
        "first_id",
        "second_id",
        F.col("first_ts").cast("timestamp_ntz").alias("first_ts"),
        F.col("second_ts").cast("timestamp_ntz").alias("second_ts"),
    )


def distinct_events(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """Drop repeats of ``key`` that arrive within the watermark delay."""
    once = one_of_each(stream, [key, "ts"], "ts")
    kept = once.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
    return kept.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def complete_days(stream: DataFrame, steps: list[str], delay: str) -> DataFrame:
    """One row per user and day on which all ``steps`` were seen, in any order, once the day closes.

    The steps of a day are bits of one number, which every task adds up before the shuffle, so a
    busy user reaches the state as one row per task and day. Rows without a time count for no day.
    """
    bits = F.create_map(*[F.lit(v) for i, step in enumerate(steps) for v in (step, 1 << i)])
    # A row without a type, such as the one that ends a stream, only moves the watermark.
    wanted = F.col("event_type").isin(steps) | F.col("event_type").isNull()
    done = stream.where(wanted).withColumn("step", bits[F.col("event_type")].cast("bigint"))
    days = done.withWatermark("ts", delay).groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.bit_or("step").alias("seen"))
    return days.where(F.col("seen") == (1 << len(steps)) - 1).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("day"))
