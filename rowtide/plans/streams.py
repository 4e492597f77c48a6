"""Event-time queries: each one runs a stream over the event files to its end."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.plans.catalog import query
from rowtide.session import work_path
from rowtide.sources.tables import read_table
from rowtide.streaming.events import (
    LOCAL_SESSIONS,
    complete_days,
    distinct_events,
    followed_by,
    window_totals,
)
from rowtide.streaming.replay import replayed_totals
from rowtide.streaming.sources import event_stream, run_to_end, run_to_table

DELAY = "1 hour"
TOTALS = "COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS total"


@query("SELECT * FROM events")
def stream_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return run_to_table(events, "copy")


@query(f"""
    SELECT event_type, CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS window_start,
           CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS window_end, {TOTALS}
    FROM events WHERE ts IS NOT NULL
    GROUP BY 1, 2, 3
""")
def stream_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = F.window("ts", "1 day")
    end = work_path(spark, "tumbling-end")
    totals = window_totals(event_stream(spark, sf_dir, end=end), ["event_type"], window, DELAY)
    return run_to_end(totals, "tumbling", end)


@query(f"""
    SELECT event_type, window_start, window_start + INTERVAL 1 DAY AS window_end, {TOTALS}
    FROM (SELECT event_type, value,
                 TIME_BUCKET(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01')
                 - INTERVAL 6 HOURS * UNNEST(RANGE(4)) AS window_start
          FROM events WHERE ts IS NOT NULL)
    GROUP BY 1, 2, 3
""")
def stream_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = F.window("ts", "1 day", "6 hours")
    end = work_path(spark, "sliding-end")
    totals = window_totals(event_stream(spark, sf_dir, end=end), ["event_type"], window, DELAY)
    return run_to_end(totals, "sliding", end)


@query(f"""
    WITH marked AS (
        SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                            <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS starts
        FROM events WHERE ts IS NOT NULL),
    numbered AS (
        SELECT *, SUM(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                    ROWS UNBOUNDED PRECEDING) AS session_no
        FROM marked)
    SELECT user_id, MIN(ts) AS window_start, MAX(ts) + INTERVAL 4 HOURS AS window_end, {TOTALS}
    FROM numbered GROUP BY user_id, session_no
""")
def stream_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = F.session_window("ts", "4 hours")
    end = work_path(spark, "sessions-end")
    totals = window_totals(event_stream(spark, sf_dir, end=end), ["user_id"], window, DELAY)
    return run_to_end(totals, "sessions", end, LOCAL_SESSIONS)


@query("SELECT * FROM events")
def stream_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives up to three times; the copies are derived in the stream."""
    events = event_stream(spark, sf_dir)
    copies = F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")))
    arriving = events.withColumn("copy", copies).drop("copy")
    return run_to_table(distinct_events(arriving, "event_id", DELAY), "distinct")


@query("""
    SELECT v.user_id, v.event_id AS first_id, p.event_id AS second_id,
           v.ts AS first_ts, p.ts AS second_ts
    FROM events v JOIN events p ON p.user_id = v.user_id
     AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 6 HOURS
    WHERE v.event_type = 'view' AND p.event_type = 'purchase'
""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = followed_by(event_stream(spark, sf_dir), "view", "purchase", timedelta(hours=6), DELAY)
    return run_to_table(pairs, "pairs")


@query("""
    SELECT user_id, CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS day FROM events
    WHERE event_type IN ('view', 'click', 'purchase')
    GROUP BY 1, 2 HAVING COUNT(DISTINCT event_type) = 3
""")
def stream_complete_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = work_path(spark, "days-end")
    days = complete_days(event_stream(spark, sf_dir, end=end), ["view", "click", "purchase"], DELAY)
    return run_to_end(days, "days", end)


@query(f"""
    WITH arriving AS (
        SELECT *, CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS window_start, DATE_TRUNC('week', ts +
               CASE WHEN event_id % 10 = 0 THEN INTERVAL 5 DAYS ELSE INTERVAL 0 DAYS END) AS week
        FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
    weeks AS (
        SELECT week, MAX(MAX(ts)) OVER (
            ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS watermark
        FROM arriving GROUP BY week)
    SELECT event_type, window_start, window_start + INTERVAL 1 DAY AS window_end, {TOTALS},
           COALESCE(window_start + INTERVAL 1 DAY <= watermark, FALSE) AS late
    FROM arriving JOIN weeks USING (week) GROUP BY ALL
""")
def stream_replay_with_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events come week by week, every tenth five days after its time; days close a day later."""
    delay = F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL 5 DAYS")).when(F.col("event_id").isNotNull(), F.expr("INTERVAL 0 DAYS"))
    events = read_table(spark, sf_dir, "events").withColumn("week", F.date_trunc("week", F.col("ts") + delay))
    return replayed_totals(events, "week", ["event_type"], F.window("ts", "1 day"), "1 day")
