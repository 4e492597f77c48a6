"""The highest inner products against all products, under grids of any size."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowtide.llm import top_products
from rowtide.llm.top_products import Grid


def plain(rows, k=5):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(whole):
        if i is not None and i % 50 == 0:
            order = sorted((-sum(map(int.__mul__, v, w)), j is None, j or 0, j) for m, (j, w) in enumerate(whole) if m != n)
            out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(order[:k])]
    return Counter(out)


def hard_rows(n=1500):
    """Lengths of all kinds, hot copies, near copies, repeated and null ids, and what takes no part."""
    rng = np.random.default_rng(1)
    odd = {97: None, 101: [0.1, float("nan")], 103: [None, 1.0], 107: [], 109: [1.0, -2.0, 0.5], 113: [0.0] * 8, 127: [float("inf")]}
    rows = []
    for i in range(n):
        v = (rng.normal(size=8) * 10 ** rng.uniform(-2, 1)).tolist() if i % 3 else [0.5] * 8
        if i > n * 0.8:
            v = [0.9, 0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.01 * (i % 2)]
        v = next((w for d, w in odd.items() if i % d == 0 and i), v)
        rows.append((i // 2 * 2 if i < 200 else None if i % 211 == 0 else i - 700, v))
    return rows


@pytest.mark.parametrize("grid", [Grid(), Grid(64, 200, 7), Grid(16, 64, 16)])
def test_matches_all_products(spark, grid):
    rows = hard_rows()
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>").withColumn("rank", F.lit("taken")).withColumn("position", F.lit(1))
    got = top_products.top_products(df.repartition(5, "vec_id"), F.col("vec_id") % 50 == 0, grid=grid).collect()
    assert Counter(map(tuple, got)) == plain(rows)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame(hard_rows(60)[:3], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    assert len(top_products.top_products(df, F.lit(True)).collect()) == 6  # two candidates each
    assert top_products.top_products(df.filter("false"), F.lit(True)).count() == 0
    assert top_products.top_products(df, F.col("vec_id") < 0).count() == 0


def test_scores_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(0, [1e12, 0.0]), (1, [1e12, 1.0])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="may not fit into a long"):
        top_products.top_products(df, F.col("vec_id") == 0).collect()


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i % 7) * 1e3 + i, -1e4 + i]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    got = top_products.top_products(df, F.col("vec_id") % 50 == 0, grid=Grid(8, 16, 2)).collect()
    assert Counter(map(tuple, got)) == plain(rows)


def test_intervals_hold_every_vector_of_the_cosine():
    rng = np.random.default_rng(2)
    units = rng.normal(size=(4000, 3))
    units /= np.linalg.norm(units, axis=1)[:, None]
    lists = top_products.Lists(units)
    for q in units[:40]:
        for cosine in (0.5, 0.9, 0.99):
            assert set(np.flatnonzero(units @ q >= cosine)) <= set(lists.near(q, cosine).tolist())


def cell(v, ids):
    import pyarrow as pa

    v = np.asarray(v, float)
    return pa.table({
        "vec_id": pa.array(ids, pa.int64()), "v": pa.array(v.tolist(), pa.list_(pa.float64())), "norm": pa.array(np.sqrt((v * v).sum(1))),
        "position": pa.array(ids, pa.int64()),
    })


def test_cells_prune_by_coordinates_and_by_length(monkeypatch):
    """Queries with close neighbours look these up; long and short vectors let whole buckets go."""
    rng = np.random.default_rng(4)
    units = rng.normal(size=(600, 6))
    units = np.concatenate([units, units[:40, None] + rng.normal(size=(40, 9, 6)) * 0.002], axis=None).reshape(-1, 6)
    units /= np.linalg.norm(units, axis=1)[:, None]
    lengths = np.where(np.arange(len(units)) % 5 == 0, 100, 1000)
    v = np.floor(units * lengths[:, None] * 30)
    v = v[np.argsort(-np.linalg.norm(v, axis=1), kind="stable")]
    vectors = cell(v, list(range(len(v))))
    queries = vectors.slice(0, 200).rename_columns(["vec_id", "v", "norm", "q"])
    looked, real = [], top_products.Lists.near
    monkeypatch.setattr(top_products.Lists, "near", lambda self, unit, cosine: looked.append(len(self.units)) or real(self, unit, cosine))
    scores = v @ v[:200].T
    for known in (False, True):
        least = [int(sorted(np.delete(scores[:, i], i))[-5]) if known else None for i in range(200)]
        got = top_products.search_cell(queries.append_column("least", [least]), vectors, 5, 64).to_pylist()
        for i in range(200):
            want = sorted(((-int(scores[j, i]), j) for j in range(len(v)) if j != i))[:5]
            assert sorted((-r["score"], r["vec_id"]) for r in got if r["q"] == i) == want
    assert len(looked) > 200
