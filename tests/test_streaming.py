"""Late rows, copies, busy users and restarts, on event files that arrive in order."""

import os
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowtide.streaming.events import complete_days, distinct_events, followed_by, window_totals
from rowtide.streaming.sources import event_stream, one_of_each, run_to_end, run_to_table

COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def write_files(folder, batches):
    """One file per batch; the file source takes them in order of modification time."""
    for number, rows in enumerate(batches):
        frame = pd.DataFrame(rows, columns=COLUMNS)
        frame["ts"] = pd.to_datetime(frame["ts"])
        path = folder / f"{number}.parquet"
        frame.to_parquet(path, coerce_timestamps="us", index=False)
        os.utime(path, (1_700_000_000 + number * 10,) * 2)
    return str(folder)


def event(number, ts, user=1, kind="view"):
    return (number, ts, user, kind, 1.25, '{"k": 1}')


def stream_of(spark, folder):
    return event_stream(spark, folder, "*.parquet", files_per_batch=1)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    folder = write_files(source, [
        [event(1, "2024-01-01 10:00"), event(2, "2024-01-01 12:30")],
        [event(3, "2024-01-01 12:40")],
        [event(4, "2024-01-01 10:30"), event(5, "2024-01-01 12:10")],
        [event(6, "2024-01-01 15:00")],
    ])
    totals = window_totals(stream_of(spark, folder), ["event_type"], F.window("ts", "1 hour"), "1 hour")
    run = (
        totals.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    run.awaitTermination()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in run.recentProgress for o in p["stateOperators"])
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    # A batch drops rows behind the watermark the batch before it worked with: 10:30 comes
    # too late for 11:30, and 12:10 does not.
    assert dropped == 1
    assert [(r["window_start"].hour, r["n"], float(r["total"])) for r in rows] == [(10, 1, 1.25), (12, 3, 3.75)]


@pytest.mark.parametrize("window", ["tumbling", "sliding", "session"])
def test_open_windows_are_emitted_at_the_end(spark, tmp_path, window):
    source, end = tmp_path / "in", str(tmp_path / "end")
    source.mkdir()
    # Out of order over files that are one batch; the last rows leave their windows open.
    folder = write_files(source, [
        [event(1, "2024-01-02 10:30"), event(2, "2024-01-03 23:59")],
        [event(3, "2024-01-01 00:00"), event(4, "2024-01-02 10:00", user=None)],
    ])
    shape = {"tumbling": F.window("ts", "1 day"), "sliding": F.window("ts", "1 day", "12 hours"), "session": F.session_window("ts", "1 hour")}[window]
    totals = window_totals(event_stream(spark, folder, "*.parquet", end=end), ["event_type"], shape, "1 hour")
    rows = run_to_end(totals, window, end).collect()
    plain = window_totals(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], shape, "1 hour")
    assert sorted(map(str, rows)) == sorted(map(str, plain.collect()))
    assert sum(r["n"] for r in rows) == (8 if window == "sliding" else 4)


@pytest.mark.parametrize("parts", [1, 3])
def test_a_streamed_table_is_a_file_or_a_folder(spark, tmp_path, parts):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table = tmp_path / "events.parquet"
    if parts == 1:
        events.toPandas().to_parquet(table, coerce_timestamps="us", index=False)
    else:
        events.repartition(parts).write.parquet(str(table))
    assert run_to_table(event_stream(spark, str(tmp_path)), "table").count() == events.count()


def test_copies_are_dropped_within_and_across_files(spark, tmp_path):
    copies = [event(7, "2024-01-01 10:00")] * 500
    folder = write_files(tmp_path, [copies + [event(8, "2024-01-01 10:01")], copies])
    kept = run_to_table(distinct_events(stream_of(spark, folder), "event_id", "1 hour"), "copies")
    assert sorted(r["event_id"] for r in kept.collect()) == [7, 8]


def test_one_of_each_keeps_the_latest_row(spark, tmp_path):
    folder = write_files(tmp_path, [[
        event(1, "2024-01-01 10:00", user=1), event(2, "2024-01-01 11:00", user=1),
        event(3, "2024-01-01 09:00", user=1), event(4, "2024-01-01 08:00", user=2),
    ]])
    kept = run_to_table(one_of_each(stream_of(spark, folder), ["user_id"], "ts"), "latest")
    assert sorted(r["event_id"] for r in kept.collect()) == [2, 4]


def test_pairs_meet_across_buckets_of_time(spark, tmp_path):
    views = [event(n, f"2024-01-01 10:{n:02}") for n in range(20)]
    purchases = [event(100 + n, f"2024-01-01 10:{n:02}:00", kind="purchase") for n in range(20)]
    purchases.append(event(200, None, kind="purchase"))
    folder = write_files(tmp_path, [views, purchases])
    pairs = run_to_table(
        followed_by(stream_of(spark, folder), "view", "purchase", timedelta(minutes=5), "1 hour"), "pairs"
    )
    got = {(r["first_id"], r["second_id"]) for r in pairs.collect()}
    assert pairs.count() == len(got)
    assert got == {(v, 100 + p) for v in range(20) for p in range(20) if 0 <= p - v <= 5}


def test_a_day_is_reported_once_and_its_state_dropped(spark, tmp_path):
    folder = write_files(tmp_path, [
        [event(1, "2024-01-01 10:00"), event(2, "2024-01-01 10:05", kind="purchase")],
        [event(3, "2024-01-01 10:10", kind="purchase"), event(4, "2024-01-01 10:20", user=2)],
        [event(5, "2024-01-01 11:00"), event(6, "2024-01-03 11:00", user=2, kind="purchase")],
        [event(7, "2024-01-03 12:00", user=3)],
        [event(8, "2024-01-01 10:30", user=2, kind="purchase")],
    ])
    days = run_to_table(complete_days(stream_of(spark, folder), ["view", "purchase"], "1 hour"), "days")
    assert [(r["user_id"], r["day"].day) for r in days.collect()] == [(1, 1)]


def test_a_restart_goes_on_after_the_last_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run():
        stream = distinct_events(stream_of(spark, str(source)), "event_id", "1 hour")
        writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first, second = [event(1, "2024-01-01 10:00")], [event(1, "2024-01-01 10:00"), event(2, "2024-01-01 10:10")]
    write_files(source, [first])
    assert run() == [1]
    write_files(source, [first, second])
    assert run() == [1, 2]
