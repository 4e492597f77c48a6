"""Exact samples against sorting by digest in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rowtide.operators import samples
from rowtide.operators.samples import equal_quotas, mixed_quotas, proportional_quotas, stratified_sample
from tests.test_plans import plan_of

SCHEMA = "a string, b int, id bigint, other string"


def some_rows(seed=1, n=3000):
    """Strata of which one holds a third of the rows; null strata and ids; ids and whole rows repeated."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = ("hot", 1) if i % 3 == 0 else (rng.choice(["x", "y", "", None]), rng.choice([1, 2, None]))
        rows.append((a, b, None if i % 97 == 0 else i, rng.choice("pq")))
    return rows + rows[:200] + [("hot", 1, 5, "same")] * 400 + [("rare", 9, 1, None)]


def digest_of(*values, seed=0):
    text = f"{seed}:" + "|".join("" if v is None else str(v) for v in values)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def assert_sampled(rows, got, quotas, seed=0):
    """Sizes are exact, every row comes from the table, and no row left out has a smaller digest."""
    assert not Counter(got) - Counter(rows)
    strata, taken = defaultdict(list), defaultdict(list)
    for r in rows:
        strata[r[:2]].append(digest_of(r[2], seed=seed))
    for r in got:
        taken[r[:2]].append(digest_of(r[2], seed=seed))
    for stratum, digests in strata.items():
        assert sorted(taken[stratum]) == sorted(digests)[: quotas.get(stratum, 0)], stratum


@pytest.mark.parametrize("settings", [{}, {"LAST_BIN_ROWS": 0}, {"LAST_BIN_ROWS": 300, "BITS_A_ROUND": 4}])
@pytest.mark.parametrize("safe", ["10000000", "0"])
def test_equals_sorting_by_digest(spark, monkeypatch, settings, safe):
    for name, value in settings.items():
        monkeypatch.setattr(samples, name, value)
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    # The sample of the large stratum ends among rows of one digest.
    smaller = sum(digest_of(r[2]) < digest_of(5) for r in rows if r[:2] == ("hot", 1))
    quota = {("hot", 1): smaller + 100, ("x", 1): 1, ("y", None): 50, (None, None): 40, ("", 2): 0, ("rare", 9): 8, ("none", 3): 4}
    quotas = spark.createDataFrame([(*k, v) for k, v in quota.items()], "a string, b int, quota int")
    spark.conf.set("rowtide.safeGroupRows", safe)
    try:
        got = sorted(map(tuple, stratified_sample(df, ["a", "b"], quotas, ["id"]).collect()), key=str)
        assert_sampled(rows, got, quota)
        # Equal rows in other partitions give an equal sample.
        moved = df.repartition(5, F.rand(3))
        assert got == sorted(map(tuple, stratified_sample(moved, ["a", "b"], quotas, ["id"]).collect()), key=str)
    finally:
        spark.conf.unset("rowtide.safeGroupRows")
    other = list(map(tuple, stratified_sample(df, ["a", "b"], quotas, ["id"], seed=4).collect()))
    assert_sampled(rows, other, quota, seed=4)
    assert Counter(other) != Counter(got)


@pytest.mark.parametrize("rows", [0, 1, 7, 100, 1234, 10**12])
def test_proportional_shares(spark, rows):
    table = some_rows(2, 900)
    df = spark.createDataFrame(table, SCHEMA)
    sizes = Counter(r[:2] for r in table)
    wanted = min(rows, len(table))
    parts = {s: divmod(n * wanted, len(table)) for s, n in sizes.items()}
    by_rest = sorted(parts, key=lambda s: (-parts[s][1], digest_of(*s)))
    more = set(by_rest[: wanted - sum(low for low, _ in parts.values())])
    got = {(r["a"], r["b"]): r["quota"] for r in proportional_quotas(df, ["a", "b"], rows).collect()}
    assert got == {s: low + (s in more) for s, (low, _) in parts.items()}
    assert sum(got.values()) == wanted


def test_mix_by_weights(spark):
    df = spark.createDataFrame([(v,) for v, n in (("a", 100), ("b", 10), ("c", 50), (None, 40), ("d", 99)) for _ in range(n)], "v string")

    def quotas(weights, rows):
        return {r["v"]: r["quota"] for r in mixed_quotas(df, "v", weights, rows).collect()}

    assert quotas({"a": 1, "b": 1, "c": 1}, 30) == {"a": 10, "b": 10, "c": 10}
    assert quotas({"a": 1, "b": 5, "c": 1}, 61) == {"a": 26, "b": 10, "c": 25}
    assert quotas({"c": 8, "a": 1, "b": 1}, 100) == {"a": 40, "b": 10, "c": 50}
    assert quotas({"a": 2, None: 1}, 100) == {"a": 67, None: 33}
    assert quotas({"a": 1, "gone": 3}, 20) == {"a": 20, "gone": 0}
    assert quotas({"a": 1, "b": 2}, 1000) == {"a": 100, "b": 10}
    assert quotas({"a": 3, "c": 2}, 0) == {"a": 0, "c": 0}
    with pytest.raises(ValueError):
        quotas({"a": 0}, 5)


def test_no_rows_and_map_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    for quotas in (equal_quotas(none, ["a"], 3), proportional_quotas(none, ["a"], 3), mixed_quotas(none, "a", {"x": 1}, 3)):
        assert stratified_sample(none, ["a"], quotas, ["id"]).count() == 0
    df = spark.range(20).select(F.lit("s").alias("a"), "id", F.create_map(F.lit("k"), "id").alias("m"))
    out = stratified_sample(df, ["a"], equal_quotas(df, ["a"], 6), ["id"])
    assert out.count() == 6 and out.columns == ["a", "id", "m"]
    with pytest.raises(ValueError):
        stratified_sample(df, [], equal_quotas(df, ["a"], 6), ["id"])


def test_only_the_rows_of_last_bins_are_put_in_order(spark):
    df = spark.createDataFrame(some_rows(), SCHEMA)
    plan = plan_of(stratified_sample(df, ["a", "b"], equal_quotas(df, ["a", "b"], 9), ["id"]))
    assert plan.count("Exchange hashpartitioning") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan
