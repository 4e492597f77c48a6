"""Least squares from merged states against numpy on whole groups."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.operators import regression
from rowtide.operators.regression import least_squares
from tests.test_plans import plan_of

SCHEMA = "k bigint, s string, x double, z double, y double"


def some_rows(seed, n, groups, mean=0.0):
    """Keys of which one holds a third of the rows, null keys and keys beyond 2**53; nulls, NaN and infinite values."""
    rng = random.Random(seed)
    names = [(2**60 + i, rng.choice(["a", "b"])) for i in range(groups)] + [(None, "a"), (1, None), (None, None)]
    rows = []
    for i in range(n):
        k, s = (7, "hot") if i % 3 == 0 else rng.choice(names)
        x, z = mean + rng.gauss(0, 1), rng.gauss(5, 2)
        y = 3 * x - 2 * z + 1 + rng.gauss(0, 0.1)
        bad = [None, float("nan"), float("inf")][i % 3]
        rows.append((k, s, x if i % 101 else bad, z, y if i % 103 else bad))
    return rows + rows[:50]


def plainly(rows):
    groups = defaultdict(list)
    for r in rows:
        if all(v is not None and np.isfinite(v) for v in r[2:]):
            groups[r[:2]].append(r[2:])
    found = {}
    for key, values in groups.items():
        v = np.array(values, dtype=np.longdouble)
        means = v.mean(axis=0)
        d = (v - means).astype(float)
        slopes = np.linalg.lstsq(d[:, :2], d[:, 2], rcond=None)[0]
        r2 = 1 - ((d[:, 2] - d[:, :2] @ slopes) ** 2).sum() / (d[:, 2] ** 2).sum()
        found[key] = (len(v), float(means[2] - slopes @ means[:2]), *slopes, r2)
    return found


@pytest.mark.parametrize("held", [50_000, 3])
@pytest.mark.parametrize("mean", [0.0, 1e7])
def test_equals_whole_groups(spark, monkeypatch, held, mean):
    monkeypatch.setattr(regression, "HELD_STATES", held)
    rows = some_rows(int(mean) + held, 4000, 25, mean)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = least_squares(df, ["k", "s"], "y", ["x", "z"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = plainly(rows)
    assert len(got) == len(want)
    for r in got:
        n, intercept, a, b, r2 = want[r["k"], r["s"]]
        assert r["n"] == n
        assert r["slopes"] == pytest.approx([a, b], rel=1e-6, abs=1e-7)
        assert r["intercept"] == pytest.approx(intercept, rel=1e-6, abs=1e-6)
        assert r["r2"] == pytest.approx(r2, rel=1e-6)


def test_what_does_not_vary(spark):
    rows = [(1, "one", 2.0, 3.0, 4.0)]
    rows += [(2, "flat x", 5.0, float(i), 2.0 * i) for i in range(9)]
    rows += [(3, "flat y", float(i), float(i * i), 6.0) for i in range(9)]
    rows += [(4, "same", float(i), 10.0 * i, 4.0 * i) for i in range(9)]
    rows += [(5, "none", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["s"]: r for r in least_squares(df, ["s"], "y", ["x", "z"]).collect()}
    assert set(got) == {"one", "flat x", "flat y", "same"}
    assert (got["one"]["n"], got["one"]["slopes"], got["one"]["intercept"], got["one"]["r2"]) == (1, [0.0, 0.0], 4.0, None)
    assert got["flat x"]["slopes"] == pytest.approx([0, 2]) and got["flat x"]["r2"] == pytest.approx(1)
    assert got["flat y"]["slopes"] == pytest.approx([0, 0]) and got["flat y"]["r2"] is None
    # Half of the rise from each of two features that are one.
    assert got["same"]["slopes"] == pytest.approx([2, 0.2])


def test_no_rows_and_refused_keys(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert least_squares(none, ["k"], "y", ["x"]).count() == 0
    for keys, error in (([], ValueError), (["x"], TypeError)):
        with pytest.raises(error):
            least_squares(none, keys, "y", ["z"])


def test_states_and_not_rows_are_shuffled(spark):
    df = spark.createDataFrame(some_rows(5, 3000, 2), SCHEMA).coalesce(2)
    states = least_squares(df, ["s"], "y", ["x", "z"])
    plan = plan_of(states)
    assert plan.count("Exchange") == 1
    assert plan.index("MapInArrow") < plan.index("Exchange") < plan.rindex("MapInArrow")
    assert states.agg(F.sum("n")).first()[0] == sum(n for n, *_ in plainly(some_rows(5, 3000, 2)).values())
