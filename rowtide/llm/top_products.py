"""Exact search for the vectors of the highest inner products, in buckets of similar length.

Vectors are turned into whole numbers, sorted by length (Euclidean norm) over all partitions
and cut into buckets. For a query of length ``|q|`` whose k-th best score so far is at least
``s``, a bucket with the greatest length ``l`` can only bring vectors whose cosine with the
query is ``s / (|q| l)`` or more: the local threshold. Above 1 the bucket, and all shorter ones,
are out. A bucket chooses for its queries by that threshold:

- length pruning, below: only the bucket's vectors of length ``s / |q|`` or more can do;
- coordinate pruning, from the cosine on where it pays: a vector close to the query lies within
  an interval on every coordinate, so the query's largest coordinates are looked up in
  sorted lists of the bucket.

What is left is verified by whole products, which are exact.

On Spark, queries and vectors meet in a grid of cells of bounded size, so that no task holds all
of either. A first round gives every query a bound, from the longest bucket; the second sends
queries and vectors to those cells only where the bound leaves anything. Cells return at most k
rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowtide.llm.catalog import query, table
from rowtide.llm.packing import positions
from rowtide.session import written

SLACK = 1e-9  # lengths and cosines are doubles; a bound is loosened by this share
COSINES = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)  # where coordinate pruning may begin
FOCUS = 3  # coordinates that a query is looked up by
GATHER = 8  # times the cost of a product of neighbouring rows that one of scattered rows has
PROBES = 16  # queries whose intervals tell where coordinate pruning pays


@dataclass(frozen=True)
class Grid:
    """Rows that are pruned together, and the most that one task holds of each kind."""

    bucket: int = 2_048
    vectors: int = 65_536
    queries: int = 4_096


def matrix(column: pa.Array) -> np.ndarray:
    """Lists as rows of one matrix; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    padded = np.zeros((len(sizes), width))
    padded[np.arange(width) < sizes[:, None]] = flat
    return padded


def whole_vectors(df: DataFrame, id: str, vector: str, scale: int) -> DataFrame:
    """``vec_id``, ``v`` (floor of ``scale`` times each component, as doubles) and ``norm``, without
    vectors that are null or hold a null, a NaN or an infinity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).drop_null()
            ids = batch.column(0).filter(batch.column(1).is_valid())
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            fine = np.bincount(rows, ~np.isfinite(flat), len(sizes)) == 0
            v = np.floor(scale * flat[fine[rows]])
            ends = np.concatenate([[0], np.cumsum(sizes[fine])])
            norms = np.sqrt(np.bincount(np.repeat(np.arange(fine.sum()), sizes[fine]), v * v, fine.sum()))
            yield pa.RecordBatch.from_arrays(
                [ids.filter(pa.array(fine)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)), pa.array(norms)],
                names=["vec_id", "v", "norm"],
            )

    return df.select(F.col(id).cast("bigint").alias("vec_id"), F.col(vector).alias("v")).mapInArrow(run, "vec_id BIGINT, v ARRAY<DOUBLE>, norm DOUBLE")


def product_kind(q: np.ndarray, c: np.ndarray) -> type:
    """The fastest numbers in which all products, and all sums on the way to them, are exact."""
    bound = float(q.max(initial=0)) * float(c.max(initial=0)) * (1 + SLACK)
    if bound >= 2**62:
        raise OverflowError("a score may not fit into a long")
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


class Lists:
    """Sorted coordinates of a bucket's vectors, each scaled to length 1; sorted when asked for."""

    def __init__(self, units: np.ndarray):
        self.units, self._sorted = units, {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._sorted:
            order = np.argsort(self.units[:, f], kind="stable")
            self._sorted[f] = order, self.units[order, f]
        return self._sorted[f]

    def interval(self, x: float, cosine: float) -> tuple[float, float]:
        """Where a coordinate of a vector may lie, if the query's is x and their cosine at least so."""
        reach = np.sqrt(max(0.0, 1 - cosine * cosine) * max(0.0, 1 - x * x)) + SLACK
        return (-1 - SLACK if -x >= cosine else x * cosine - reach), (1 + SLACK if x >= cosine else x * cosine + reach)

    def near(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that lie within the query's intervals on its largest coordinates."""
        found = None
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS].tolist():
            low, high = self.interval(float(unit[f]), cosine)
            if found is None:
                order, values = self.coordinate(f)
                found = order[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]
            else:
                at = self.units[found, f]
                found = found[(at >= low) & (at <= high)]
        return found if found is not None else np.arange(len(self.units))

    def pays_from(self, units: np.ndarray) -> float:
        """The least cosine from which looking up costs less than products with the whole bucket."""
        for cosine in COSINES:
            rows = [len(self.near(u, cosine)) for u in units[:PROBES]]
            if rows and GATHER * sum(rows) / len(rows) < len(self.units):
                return cosine
        return np.inf


def best(owner: np.ndarray, ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores of each owner, ties to the smaller id, ids not known last."""
    order = np.lexsort((ids, ~known, -scores, owner))
    sorted_owner = owner[order]
    first = np.concatenate([[True], sorted_owner[1:] != sorted_owner[:-1]]) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def search_cell(queries: pa.Table, vectors: pa.Table, k: int, bucket: int) -> pa.Table:
    """The k best of a cell's vectors for each of its queries, but none that its bound excludes."""
    vectors = vectors.take(np.argsort(vectors["position"].to_numpy(), kind="stable"))
    q, c = matrix(queries["v"]), matrix(vectors["v"])
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, c))
    q_norm, c_norm = queries["norm"].to_numpy(), vectors["norm"].to_numpy()
    kind = product_kind(q_norm, c_norm)
    units = q / np.where(q_norm > 0, q_norm, 1)[:, None]
    q, whole = q.astype(kind), c.astype(kind)
    place, known = vectors["position"].to_numpy(), vectors["vec_id"].is_valid().to_numpy()
    ids = vectors["vec_id"].fill_null(0).to_numpy()
    own = queries["q"].to_numpy()
    lowest = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
    least = queries["least"].cast(pa.float64()).fill_null(-np.inf).to_numpy().copy()
    held = np.zeros((0, 3), np.int64)  # query, vector, score

    for start in range(0, len(place), bucket):
        lengths, part = c_norm[start : start + bucket], slice(start, start + bucket)
        reach = q_norm * lengths[0]
        bounded = least > 0
        local = np.where(bounded, least / np.where(reach > 0, reach, 1), -1.0)
        local[bounded & (reach == 0)] = np.inf
        alive = local <= 1 + SLACK
        if not alive.any():
            break  # the buckets behind this one are shorter
        found = [held]
        near = alive & (local >= COSINES[0])
        if near.any():
            lists = Lists(c[part] / np.where(lengths > 0, lengths, 1)[:, None])
            near &= local >= lists.pays_from(units[near])
        for i in np.flatnonzero(near):
            at = lists.near(units[i], min(1.0, local[i] * (1 - SLACK)))
            at = at[place[start + at] != own[i]]
            score = whole[start + at] @ q[i]
            fit = score >= least[i]
            found.append(np.stack([np.full(fit.sum(), i), start + at[fit], score[fit].astype(np.int64)], 1))
        rest = np.flatnonzero(alive & ~near)
        if len(rest):
            # Lengths fall within the bucket: what the least demanding query needs is its beginning.
            needed = np.where(bounded[rest], least[rest] / np.where(q_norm[rest] > 0, q_norm[rest], 1), -1.0).min() * (1 - SLACK)
            n = int(np.searchsorted(-lengths, -needed, "right"))
            score = q[rest] @ whole[start : start + n].T
            at = np.searchsorted(place[start : start + n], own[rest])
            inside = np.flatnonzero((at < n) & (place[np.minimum(start + at, len(place) - 1)] == own[rest]))
            score[inside, at[inside]] = lowest
            new = np.flatnonzero(least[rest] == -np.inf)
            if n > k and len(new):
                kth = np.partition(score[new], n - k, axis=1)[:, n - k].astype(np.float64)
                least[rest[new]] = np.where(kth == float(lowest), -np.inf, kth)
            i, j = np.nonzero((score >= least[rest, None]) & (score != lowest))
            found.append(np.stack([rest[i], start + j, score[i, j].astype(np.int64)], 1))
        held = np.concatenate(found)
        held = held[best(held[:, 0], ids[held[:, 1]], known[held[:, 1]], held[:, 2], k)]
        full = np.bincount(held[:, 0], minlength=len(own)) == k
        kth = np.full(len(own), -np.inf)
        kth[held[:, 0]] = held[:, 2]  # the last of each query stays
        least = np.where(full, np.maximum(least, kth), least)

    return pa.table({
        "q": queries["q"].take(pa.array(held[:, 0])), "query_id": queries["vec_id"].take(pa.array(held[:, 0])),
        "vec_id": vectors["vec_id"].take(pa.array(held[:, 1])), "score": pa.array(held[:, 2]),
    })


def top_products(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding", grid: Grid = Grid()) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score``: the k rows of the highest inner
    product with each query, ties to the smaller id (null last).

    Components x count as floor(scale * x). Queries are the rows where ``is_query``, stated over
    the id column, is true; a row is no candidate for itself, but a repeated row is one for its
    copies, and each of them has results of its own. Vectors that are null or hold a null, a NaN
    or an infinity take no part. A shorter vector counts as if it ended in zeros, so an empty one
    scores 0. Fewer than k candidates give fewer rows; no rows or no queries give none. Other
    columns are not used. Scores beyond 2**62 are refused.
    """
    spark = df.sparkSession
    base = whole_vectors(df, id, vector, scale)
    rows, spot = positions(base, [F.desc("norm"), F.asc_nulls_last("vec_id"), F.hash("v")], "vectors")
    rows = rows.withColumnRenamed(spot, "position")
    asked = rows.filter(is_query).withColumnRenamed("position", "q")
    asked, spot = positions(asked, [F.desc("norm"), "q"], "queries")
    asked = asked.withColumn("row_cell", F.floor(F.col(spot) / grid.queries)).drop(spot)
    total, queries = rows.count(), asked.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bands = max(-(-queries // grid.queries), 1)
    buckets = max(-(-total // grid.bucket), 1)
    across = max(1, min(buckets, max(-(-total // grid.vectors), -(-2 * tasks // bands))))
    cell = -(-buckets // across) * grid.bucket
    kinds = "q BIGINT, query_id BIGINT, vec_id BIGINT, score BIGINT"

    def meet(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda a, b: search_cell(a, b, k, grid.bucket), kinds)

    # First bounds: the longest bucket, once for each band of queries.
    every_band = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bands - 1).cast("bigint")))
    longest = rows.filter(F.col("position") < grid.bucket).withColumn("row_cell", every_band)
    first = written(meet(asked.withColumn("least", F.lit(None).cast("bigint")), longest, "row_cell"), "first-scores")
    bounds = first.groupBy("q").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))

    # The other cells, where the bound of a query leaves anything.
    others = rows.filter(F.col("position") >= grid.bucket).withColumn("column_cell", F.floor(F.col("position") / cell))
    lengths = others.groupBy("column_cell").agg(F.max("norm").alias("longest"))
    every_cell = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(-(-total // cell), 1) - 1).cast("bigint")))
    sent = asked.join(bounds, "q", "left").withColumn("column_cell", every_cell).join(lengths, "column_cell")
    within = F.col("norm") * F.col("longest") * (1 + SLACK) >= F.col("least")
    sent = written(sent.filter(F.col("least").isNull() | (F.col("least") <= 0) | within).drop("longest"), "sent")
    alive = sent.select(F.col("row_cell").alias("band"), F.col("column_cell").alias("at")).distinct()
    copies = others.join(alive, F.col("column_cell") == F.col("at")).drop("column_cell")
    later = meet(sent, copies.select("position", "vec_id", "v", "norm", F.col("band").alias("row_cell"), F.col("at").alias("column_cell")), "row_cell", "column_cell")

    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = first.unionByName(later).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


OP11_SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q, vectors c WHERE q.vec_id % 50 = 0 AND q.r <> c.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS n FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""


@query(OP11_SQL)
def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)
