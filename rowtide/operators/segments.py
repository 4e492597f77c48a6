"""Time series as line segments within an error bound, by a table function that keeps state over rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.columns import micros, timestamp_from_micros

SEGMENT = "_t0 BIGINT, _t1 BIGINT, start_value DOUBLE, end_value DOUBLE, n BIGINT"


def line_segments(df: DataFrame, keys: list[str], ts: str, value: str, tiebreak: str, error: float, block_micros: int) -> DataFrame:
    """Per series of equal ``keys`` the segments ``started``, ``ended``, ``start_value``, ``end_value``, ``n``.

    Each of the ``n`` rows that a segment stands for is within ``error`` of its line. A segment begins at
    a row and takes the rows that follow, by ``ts`` and ``tiebreak``, as long as one line through its
    beginning is within the bound of all; the line is the middle one. Of rows at the time of its
    beginning it takes those within the bound of the beginning's value.

    Time is cut into blocks of ``block_micros``, whatever the size of a series, and no segment goes over
    their edges. Series and block are the partition, so a busy series is spread over as many tasks as it
    has blocks. The state is one open segment. Rows without a time or a finite value take no part;
    null is a key like others.
    """
    number = F.col(value).cast("double")
    rows = df.withColumns({"_t": micros(ts), "_v": number, "_tie": F.col(tiebreak)})
    rows = rows.where(F.col("_t").isNotNull() & number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf")))
    rows = rows.withColumn("_block", F.expr(f"(_t - pmod(_t, {block_micros})) div {block_micros}"))
    rows = rows.select(*keys, "_block", "_t", "_v", "_tie")
    result = T.StructType([*[df.schema[k] for k in keys], *T.StructType.fromDDL(SEGMENT)])
    field_names = result.names[len(keys):]

    class Segments:
        """One instance a partition; its rows come in order, in batches."""

        def __init__(self) -> None:
            self.series = None
            self.segment = None  # beginning, last time, rows, and the slopes that are still possible

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            if not batch.num_rows:
                return
            if self.series is None:
                self.series = [batch.column(k).slice(0, 1) for k in keys]
            closed = []
            for t, v in zip(batch.column("_t").to_pylist(), batch.column("_v").to_pylist()):
                if self.segment:
                    t0, v0, _, n, low, high = self.segment
                    if t == t0:
                        fits = abs(v - v0) <= error
                    else:
                        low = max(low, (v - error - v0) / (t - t0))
                        high = min(high, (v + error - v0) / (t - t0))
                        fits = low <= high
                    if fits:
                        self.segment = t0, v0, t, n + 1, low, high
                        continue
                    closed.append(self._ended())
                self.segment = t, v, t, 1, -math.inf, math.inf
            if closed:
                yield self._table(closed)

        def terminate(self) -> Iterator[pa.Table]:
            if self.segment:
                yield self._table([self._ended()])

        def _ended(self) -> tuple:
            t0, v0, t1, n, low, high = self.segment
            return t0, t1, v0, v0 + (low + high) / 2 * (t1 - t0) if t1 > t0 else v0, n

        def _table(self, segments: list[tuple]) -> pa.Table:
            columns = [pa.concat_arrays([s] * len(segments)) for s in self.series]
            return pa.table([*columns, *map(pa.array, zip(*segments))], names=[*keys, *field_names])

    segments = F.arrow_udtf(Segments, returnType=result)
    found = segments(rows.asTable().partitionBy(*keys, "_block").orderBy("_t", "_tie"))
    return found.select(
        *keys, timestamp_from_micros("_t0").alias("started"), timestamp_from_micros("_t1").alias("ended"), "start_value", "end_value", "n"
    )
