"""Late rows beside the result of a replayed stream, against a plain replay."""

import random
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowtide.sources.tables import SCHEMAS
from rowtide.streaming.replay import replayed_totals

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def events_of(seed, n):
    """Times up to four days behind the arrival's; one type holds half of the rows; nulls, and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        arrival = rng.choice([1, 2, 3, 5, 10])
        ts = START + timedelta(days=arrival) + rng.random() * timedelta(days=1) - rng.choice([0, 0, 0, 30, 96]) * HOUR
        ts = None if i % 41 == 0 else ts.replace(microsecond=rng.choice([0, 999_999]))
        rows.append((i, ts, 1, rng.choice(["a", "a", "b", None]), i / 4, None, None if i % 53 == 0 else arrival))
    return rows + rows[:20]


def plainly(rows, width, slide, delay):
    """Counts and sums by type, window and lateness; the watermark is that of the arrivals before."""
    totals, watermark = Counter(), datetime.min
    for arrival in sorted({r[6] for r in rows if r[1] and r[6]}):
        now = [r for r in rows if r[6] == arrival and r[1]]
        for _, ts, _, kind, value, _, _ in now:
            start = START - timedelta(days=30)
            start += (ts - start) // slide * slide
            while start + width > ts:
                late = start + width <= watermark
                totals[kind, start, start + width, late, "n"] += 1
                totals[kind, start, start + width, late, "total"] += Decimal(value).quantize(Decimal("0.01"))
                start -= slide
        watermark = max(watermark, max(r[1] for r in now) - delay)
    return +totals


@pytest.mark.parametrize("width, slide", [(24, 24), (24, 6)])
def test_equals_a_plain_replay(spark, width, slide):
    rows = events_of(width + slide, 600)
    events = spark.createDataFrame(rows, SCHEMAS["events"] + ", arrival int").repartition(5)
    got = replayed_totals(events, "arrival", ["event_type"], F.window("ts", f"{width} hours", f"{slide} hours"), "12 hours")
    found = Counter()
    for r in got.collect():
        for name in ("n", "total"):
            key = (r["event_type"], r["window_start"], r["window_end"], r["late"], name)
            assert key not in found
            found[key] = r[name]
    want = plainly(rows, width * HOUR, slide * HOUR, 12 * HOUR)
    assert +found == want
    assert any(k[3] for k in want) and any(not k[3] for k in want)


def test_no_events_and_one_arrival(spark):
    def replayed(rows):
        events = spark.createDataFrame(rows, SCHEMAS["events"] + ", arrival int")
        return replayed_totals(events, "arrival", [], F.window("ts", "1 day"), "1 hour")

    assert replayed([]).count() == 0
    assert replayed([(1, None, 1, "a", 1.0, None, 1), (2, START, 1, "a", 1.0, None, None)]).count() == 0
    far_apart = [(1, START, 1, "a", 1.0, None, 7), (2, START + timedelta(days=900), 1, "a", None, None, 7)]
    assert sorted((r["n"], r["total"], r["late"]) for r in replayed(far_apart).collect() if r["total"]) == [(1, 1, False)]
    assert replayed(far_apart).where("late").count() == 0
