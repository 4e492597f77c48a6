"""Line segments: the bound on all rows, and the same segments as from a plain walk."""

import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from rowtide.operators.segments import line_segments
from tests.test_plans import plan_of

SCHEMA = "k bigint, s string, id bigint, ts timestamp_ntz, v double"
START = datetime(1970, 1, 1)
HOUR = 3_600_000_000


def some_rows(seed, n):
    """Walks of which one holds a third of the rows; equal and early times, nulls, NaN, and repeated rows."""
    rng = random.Random(seed)
    at, rows = Counter(), []
    for i in range(n):
        key = (7, "hot") if i % 3 == 0 else rng.choice([(1, "a"), (1, None), (None, "a"), (2**60 + 1, "b")])
        at[key] += rng.choice([0, 1, 60_000_000, HOUR // 2, HOUR])
        ts = START + timedelta(microseconds=at[key] - 30 * HOUR)
        v = 20 * math.sin(at[key] / HOUR / 3) + rng.gauss(0, 1)
        rows.append((*key, i, None if i % 71 == 0 else ts, [None, math.nan, math.inf][i % 3] if i % 53 == 0 else v))
    return rows + rows[:30]


def plainly(rows, error, block):
    series = defaultdict(list)
    for k, s, i, ts, v in rows:
        if ts is not None and v is not None and math.isfinite(v):
            t = (ts - START) // timedelta(microseconds=1)
            series[k, s, t // block].append((t, i, v))
    found, off = Counter(), 0.0
    for (k, s, _), points in series.items():
        points.sort()
        while points:
            t0, _, v0 = points[0]
            size, low, high = 1, -math.inf, math.inf
            for t, _, v in points[1:]:
                a, b = (low, high) if t == t0 else (max(low, (v - error - v0) / (t - t0)), min(high, (v + error - v0) / (t - t0)))
                if (abs(v - v0) > error) if t == t0 else (a > b):
                    break
                size, low, high = size + 1, a, b
            t1 = points[size - 1][0]
            slope = (low + high) / 2 if t1 > t0 else 0.0
            off = max([off, *(abs(v0 + slope * (t - t0) - v) for t, _, v in points[:size])])
            found[k, s, t0, t1, v0, v0 + slope * (t1 - t0), size] += 1
            points = points[size:]
    assert off <= error + 1e-9
    return found


@pytest.mark.parametrize("error, block", [(0.0, HOUR), (2.5, 24 * HOUR), (1e9, 10_000 * HOUR)])
def test_equals_a_plain_walk_within_the_bound(spark, error, block):
    rows = some_rows(int(error) % 97, 2500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        got = line_segments(df, ["k", "s"], "ts", "v", "id", error, block).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = timedelta(microseconds=1)
    found = Counter((r["k"], r["s"], (r["started"] - START) // unit, (r["ended"] - START) // unit, r["start_value"], r["end_value"], r["n"]) for r in got)
    assert found == plainly(rows, error, block)


def test_a_line_is_one_segment_and_no_rows_are_none(spark):
    line = [(1, "a", i, START + timedelta(minutes=i), 3.0 * i) for i in range(500)]
    df = spark.createDataFrame(line, SCHEMA)
    (one,) = line_segments(df, ["k"], "ts", "v", "id", 0.001, 1000 * HOUR).collect()
    assert (one["n"], one["start_value"], one["end_value"]) == (500, 0.0, pytest.approx(3.0 * 499))
    assert line_segments(df.limit(0), ["k", "s"], "ts", "v", "id", 1.0, HOUR).count() == 0
    unread = spark.createDataFrame([(1, "a", 1, None, 1.0), (1, "a", 2, START, None)], SCHEMA)
    assert line_segments(unread, ["k"], "ts", "v", "id", 1.0, HOUR).count() == 0


def test_a_busy_series_is_spread_by_blocks(spark):
    df = spark.createDataFrame(some_rows(3, 300), SCHEMA)
    plan = plan_of(line_segments(df, ["k"], "ts", "v", "id", 1.0, HOUR))
    assert plan.count("Exchange hashpartitioning") == 1
    exchange = plan[plan.index("Exchange hashpartitioning") :].split("\n")[0]
    assert "partition_by_0" in exchange and "partition_by_1" in exchange  # the key and the block
