"""Least squares per group on several columns: an aggregate of states that merge.

A state is a count, means and centred products, which is what rounding spares: the sums of a
plain Gram matrix lose the digits that are left when a large mean is taken off. Tasks bring their rows
to one state per group; states, not rows, are shuffled and merged. Python sees whole Arrow
batches in both phases, and no group is a call of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# States that a task holds before it merges them, and hands them on if that leaves most of them.
HELD_STATES = 50_000
# Directions of standardised features with less of the largest one's variance count as none.
LEAST_VARIANCE = 1e-10


def least_squares(df: DataFrame, keys: list[str], target: str, features: list[str]) -> DataFrame:
    """Per group: ``n`` rows, ``intercept``, a coefficient per feature in ``slopes``, and ``r2``.

    Rows with a null, NaN or infinite value take no part, and a group without others gives no row.
    Null is a key like others. A feature that does not vary in a group has slope 0; of features that
    depend on each other the slopes are those of least norm, in standard deviations. ``r2`` is
    null if the target does not vary. Keys must not be floating-point numbers.
    """
    for key in keys:
        if isinstance(df.schema[key].dataType, (T.FloatType, T.DoubleType)):
            raise TypeError(f"{key} is floating-point, and such keys are not told apart safely")
    if not keys:
        raise ValueError("name the columns of the groups")
    columns = [*features, target]
    values = [F.col(c).cast("double") for c in columns]
    finite = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) for v in values]
    rows = df.where(reduce(and_, finite)).select(*keys, F.array(*values).alias("values"))
    kept = [df.schema[k] for k in keys]
    state = T.StructType([*kept, *T.StructType.fromDDL("n BIGINT, means ARRAY<DOUBLE>, products ARRAY<DOUBLE>")])
    result = T.StructType([*kept, *T.StructType.fromDDL("n BIGINT, intercept DOUBLE, slopes ARRAY<DOUBLE>, r2 DOUBLE")])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(_first_states(batch, keys, len(columns)))
                size += held[-1].num_rows
            if size > HELD_STATES:
                merged = _merged(pa.concat_tables(held), keys, len(columns))
                held, size = [merged], merged.num_rows
                if size > HELD_STATES // 2:
                    yield from merged.to_batches()
                    held, size = [], 0
        if held:
            yield from _merged(pa.concat_tables(held), keys, len(columns)).to_batches()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_state = None  # of the last key so far, whose states may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                states = pa.Table.from_batches([batch])
                states = pa.concat_tables([open_state, states]) if open_state else states
                merged = _merged(states, keys, len(columns))
                open_state = merged.slice(merged.num_rows - 1)
                yield from _solved(merged.slice(0, merged.num_rows - 1), keys, len(columns)).to_batches()
        if open_state:
            yield from _solved(open_state, keys, len(columns)).to_batches()

    states = rows.mapInArrow(partial, state).repartition(*keys).sortWithinPartitions(*keys)
    return states.mapInArrow(final, result)


def _grouped(table: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The keys, in order of first rows; row numbers group by group; and where each group starts."""
    numbered = table.select(keys).append_column("_row", pa.array(np.arange(table.num_rows)))
    groups = numbered.group_by(keys, use_threads=False).aggregate([("_row", "list")])
    lists = groups["_row_list"].combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    return groups.select(keys), lists.flatten().to_numpy(), np.cumsum(sizes) - sizes


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _states(groups: pa.Table, n: np.ndarray, means: np.ndarray, products: np.ndarray) -> pa.Table:
    columns = {"n": pa.array(n.astype(np.int64)), "means": _lists(means), "products": _lists(products)}
    for name, column in columns.items():
        groups = groups.append_column(name, column)
    return groups


def _first_states(batch: pa.RecordBatch, keys: list[str], width: int) -> pa.Table:
    """Every row is a state of its own, of one row and no products."""
    table = pa.Table.from_batches([batch])
    values = _matrix(table["values"], width)
    return _merge(table, keys, np.ones(len(values)), values, None)


def _merged(table: pa.Table, keys: list[str], width: int) -> pa.Table:
    products = _matrix(table["products"], width * (width + 1) // 2)
    return _merge(table, keys, table["n"].to_numpy().astype(float), _matrix(table["means"], width), products)


def _merge(table: pa.Table, keys: list[str], n: np.ndarray, means: np.ndarray, products: np.ndarray | None) -> pa.Table:
    """One state per key: products of all add up, with those of the means around the common mean."""
    groups, order, starts = _grouped(table, keys)
    n, means = n[order], means[order]
    total = np.add.reduceat(n, starts)
    # Around any one of them first, so that large means leave their digits to the differences.
    sizes = np.diff(np.append(starts, len(n)))
    base = means[starts]
    away = means - np.repeat(base, sizes, axis=0)
    shift = np.add.reduceat(n[:, None] * away, starts) / total[:, None]
    away -= np.repeat(shift, sizes, axis=0)
    i, j = np.triu_indices(means.shape[1])
    spread = n[:, None] * away[:, i] * away[:, j]
    if products is not None:
        spread += products[order]
    return _states(groups, total, base + shift, np.add.reduceat(spread, starts))


def _solved(states: pa.Table, keys: list[str], width: int) -> pa.Table:
    means, packed = _matrix(states["means"], width), _matrix(states["products"], width * (width + 1) // 2)
    i, j = np.triu_indices(width)
    full = np.zeros((len(means), width, width))
    full[:, i, j] = full[:, j, i] = packed
    spread = np.sqrt(np.einsum("gkk->gk", full))
    unit = np.where(spread > 0, spread, 1.0)
    full /= unit[:, :, None] * unit[:, None, :]
    inverse = np.linalg.pinv(full[:, :-1, :-1], rcond=LEAST_VARIANCE, hermitian=True)
    standard = np.einsum("gkl,gl->gk", inverse, full[:, :-1, -1])
    slopes = standard * unit[:, -1:] / unit[:, :-1]
    slopes = np.where(spread[:, :-1] > 0, slopes, 0.0)
    explained = np.einsum("gk,gk->g", standard, full[:, :-1, -1])
    found = states.select([*keys, "n"])
    found = found.append_column("intercept", pa.array(means[:, -1] - np.einsum("gk,gk->g", slopes, means[:, :-1])))
    found = found.append_column("slopes", _lists(slopes))
    return found.append_column("r2", pa.array(explained, mask=spread[:, -1] == 0))
