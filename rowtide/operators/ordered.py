"""Ordered calculations within groups, for groups of any size.

A Spark window sends each group to one task. Where a group may hold a third of all
rows that task decides the run time, so ``order_groups`` looks for such groups first.
Without one, every calculation below is the plain Spark window. With one, the large
groups, and only those, are cut along their order into blocks. Each block is its own
window partition, and what a block needs from the blocks around it (a sum, a count, a
last row) comes from a table with one row per block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowtide.functions.columns import micros
from rowtide.session import written

# A group up to this size is left to one task. Set it per session with this name.
SAFE_GROUP_ROWS_SETTING = "rowtide.safeGroupRows"
SAFE_GROUP_ROWS = 10_000_000
# More blocks than tasks, so that tasks get near equal shares of them.
BLOCKS_PER_TASK = 4

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Order:
    """Order of the rows in a group: one number, date or timestamp column, then a number.

    ``tiebreak`` must tell rows of equal ``column`` apart wherever the calculation
    depends on their order. As in any Spark window, nulls come first ascending and last
    descending, and NaN is above all numbers.
    """

    column: str
    descending: bool = False
    tiebreak: str | None = None


@dataclass(frozen=True)
class OrderedGroups:
    df: DataFrame
    keys: tuple[str, ...]
    order: Order
    split: bool

    @property
    def _parts(self) -> list[str]:
        return [*self.keys, "_block", "_sub"] if self.split else list(self.keys)

    def _by_value(self) -> list[Column]:
        column = F.col("_at")
        if not self.order.descending:
            return [column.asc_nulls_first()]
        # ``_at`` rises as the order goes down, save for NaN, which comes first.
        nan_first = [F.isnan(column).desc()] if self._floating() else []
        return [*nan_first, column.asc_nulls_last()]

    def _floating(self) -> bool:
        return isinstance(self.df.schema["_at"].dataType, (T.FloatType, T.DoubleType))

    def _sort(self) -> list[Column]:
        return [*self._by_value(), F.col("_tie")]

    def _sort_value(self) -> Column:
        rank = F.col("_at").isNull().cast("int") * (1 if self.order.descending else -1)
        if self.order.descending and self._floating():
            rank = rank - F.isnan("_at").cast("int")
        return F.struct(rank.alias("n"), "_at", "_tie")

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self._parts).orderBy(*self._sort())

    def _with(self, df: DataFrame) -> OrderedGroups:
        return replace(self, df=df)

    def _carry(
        self,
        summaries: list[Column],
        carried: Callable[[WindowSpec], list[Column]],
    ) -> DataFrame:
        """Join each row with what the other blocks of its group hand to its block.

        The block table has at most one row per large group and block, whatever the
        number of rows. It is written first, so that its size is known when Spark
        chooses between a broadcast and a shuffled join.
        """
        along = Window.partitionBy(*self.keys, F.lit(0)).orderBy("_block", "_sub")
        blocks = self.df.where("_block is not null").groupBy(*self._parts).agg(*summaries)
        blocks = blocks.withColumn("_opens", ~F.lag("_block").over(along).eqNullSafe(F.col("_block")))
        table = blocks.select(
            *[F.col(k).alias(f"_carry_{k}") for k in self._parts], *carried(along)
        )
        table = written(table, "blocks")
        match = [F.col(k).eqNullSafe(F.col(f"_carry_{k}")) for k in self._parts]
        joined = self.df.join(table, on=match, how="left")
        return joined.drop(*[f"_carry_{k}" for k in self._parts])

    def with_column(self, name: str, column: Column) -> OrderedGroups:
        return self._with(self.df.withColumn(name, column))

    def running_sum(self, value: str, name: str) -> OrderedGroups:
        """Sum of ``value`` over the group's rows up to and including this one.

        Floating-point values are refused: their sum would depend on where a group is cut.
        """
        if self.df.select(value).schema[0].dataType.typeName() in ("float", "double"):
            raise TypeError(f"running_sum needs exact values, and {value} is floating-point")
        local = F.sum(value).over(self.window().rowsBetween(FIRST, 0))
        if not self.split:
            return self.with_column(name, local)
        kind = self.df.select(F.sum(value)).schema[0].dataType
        df = self._carry(
            [F.sum(value).alias("_sum")],
            lambda along: [F.sum("_sum").over(along.rowsBetween(FIRST, -1)).alias("_before")],
        ).withColumn(name, local)
        total = F.coalesce(F.col(name) + F.col("_before"), F.col(name), F.col("_before"))
        return self._with(df.withColumn(name, total.cast(kind)).drop("_before"))

    def ranks(self, tiles: int | None = None) -> OrderedGroups:
        """Add ``row_number``, ``rank`` and ``dense_rank``.

        With ``tiles``, add ``tile`` as well: that many parts per group whose sizes
        differ by one at most, the larger ones first.
        """
        local = {"row_number": F.row_number(), "rank": F.rank(), "dense_rank": F.dense_rank()}
        by_value = Window.partitionBy(*self._parts).orderBy(*self._by_value())
        local = {
            name: column.over(self.window() if name == "row_number" else by_value).cast("bigint")
            for name, column in local.items()
        }
        if tiles:
            local["tile"] = F.ntile(tiles).over(self.window()).cast("bigint")
        if not self.split:
            return self._with(self.df.withColumns(local))

        # A block cut by the tiebreak holds a single value, so its parts share a rank.
        def carried(along: WindowSpec) -> list[Column]:
            smaller = along.orderBy("_block").rangeBetween(FIRST, -1)
            values = F.when(F.col("_opens"), F.col("_values")).otherwise(0)
            return [
                F.sum("_rows").over(along.rowsBetween(FIRST, -1)).alias("_before_row_number"),
                F.sum("_rows").over(smaller).alias("_before_rank"),
                F.sum(values).over(smaller).alias("_before_dense_rank"),
                F.sum("_rows").over(along.rowsBetween(FIRST, LAST)).alias("_size"),
            ]

        has_null = F.max(F.col("_at").isNull()).cast("int")
        df = self._carry(
            [F.count("*").alias("_rows"), (F.count_distinct("_at") + has_null).alias("_values")],
            carried,
        ).withColumns(local)
        for name in ("row_number", "rank", "dense_rank"):
            before = F.coalesce(f"_before_{name}", F.lit(0))
            df = df.withColumn(name, F.col(name) + before).drop(f"_before_{name}")
        if tiles:
            # Only large groups, which consist of several blocks, carry a size.
            small, larger = F.expr(f"_size div {tiles}"), F.col("_size") % tiles
            at = F.col("row_number") - 1
            edge = larger * (small + 1)
            tile = F.when(at < edge, F.floor(at / (small + 1))).otherwise(
                larger + F.floor((at - edge) / F.greatest(small, F.lit(1)))
            )
            df = df.withColumn("tile", F.coalesce((tile + 1).cast("bigint"), F.col("tile")))
        return self._with(df.drop("_size"))

    def previous(self, value: str, name: str) -> OrderedGroups:
        """``value`` of the row before, null on the first row."""
        return self._neighbour(value, name, F.lag, F.max_by)

    def following(self, value: str, name: str) -> OrderedGroups:
        """``value`` of the row after, null on the last row."""
        return self._neighbour(value, name, F.lead, F.min_by)

    def _neighbour(self, value: str, name: str, shift: Callable, edge: Callable) -> OrderedGroups:
        if not self.split:
            return self.with_column(name, shift(value).over(self.window()))
        # The struct tells a null value from a missing row.
        boxed = F.struct(F.col(value).alias("v"))
        df = self._carry(
            [edge(boxed, self._sort_value()).alias("_edge")],
            lambda along: [shift("_edge").over(along).alias("_outside")],
        )
        inside = shift(boxed).over(self.window())
        df = df.withColumn(name, F.coalesce(inside, F.col("_outside"))["v"])
        return self._with(df.drop("_outside"))

    def last_known(self, value: str, name: str) -> OrderedGroups:
        """Latest ``value`` that is not null, up to and including this row."""
        local = F.last(value, ignorenulls=True).over(self.window().rowsBetween(FIRST, 0))
        if not self.split:
            return self.with_column(name, local)
        known = F.when(F.col(value).isNotNull(), self._sort_value())
        df = self._carry(
            [F.max_by(value, known).alias("_last")],
            lambda along: [
                F.last("_last", ignorenulls=True).over(along.rowsBetween(FIRST, -1)).alias("_before")
            ],
        )
        return self._with(df.withColumn(name, F.coalesce(local, F.col("_before"))).drop("_before"))

    def result(self) -> DataFrame:
        return self.df.drop("_at", "_tie", "_block", "_sub")


def order_groups(
    df: DataFrame, keys: list[str], order: Order, bounded_by: DataFrame | None = None
) -> OrderedGroups:
    """Group ``df`` by ``keys`` and order each group; no keys means one group of all rows.

    Reads the key columns once to find large groups. With one, the rows are read several
    times more, for the block limits and for what blocks hand on.

    Where rows took a shuffle to compute, ``bounded_by`` gives cheaper rows with the same
    keys and at least as many rows in each group. They are searched first, and only if
    they have a large group are the real rows computed early, written, and searched.
    """
    at, kind = F.col(order.column), df.schema[order.column].dataType
    if isinstance(kind, T.TimestampNTZType):
        at = micros(at)
    elif isinstance(kind, T.TimestampType):
        at = F.unix_micros(at)
    elif isinstance(kind, T.DateType):
        at = F.unix_date(at)
    elif not isinstance(kind, T.NumericType):
        raise TypeError(f"{order.column} is {kind.simpleString()}, not a number, date or timestamp")
    if order.descending:
        # The complement of an integer turns the order round and cannot overflow.
        fractional = isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))
        at = -at if fractional else F.bitwise_not(at)
    tie = F.col(order.tiebreak) if order.tiebreak else F.lit(0)
    keyed = df.withColumns({"_at": at, "_tie": tie})

    tasks = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    large = _large_groups(df if bounded_by is None else bounded_by, group, tasks)
    if large and bounded_by is not None:
        keyed = written(keyed, "rows")
        large = _large_groups(keyed, group, tasks)
    if large:
        keyed = _cut(keyed, group.isin(large), order.descending, tasks * BLOCKS_PER_TASK)
    return OrderedGroups(keyed, tuple(keys), order, bool(large))


def _large_groups(df: DataFrame, group: Column, tasks: int) -> list[int]:
    """Hashes of the groups above a fair task's share of rows; fewer than ``tasks``.

    The counts come from frequent-items sketches of fixed size. Every task makes one, about the
    root of their number are merged at once, and the last task merges what is left. A group that
    they miss costs time, not correctness.
    """
    safe = int(df.sparkSession.conf.get(SAFE_GROUP_ROWS_SETTING, str(SAFE_GROUP_ROWS)))
    tracked = min(1_000_000, max(10_000, 4 * tasks))
    some = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks) + 1))
    parts = df.select(group.alias("g"), some.alias("some")).groupBy("some").agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(g, {tracked})").alias("s")
    )
    # By a constant, as no sketches cannot be combined: an empty table gives no row.
    found = parts.groupBy(F.lit(True)).agg(
        F.sum("n").alias("n"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {tracked}), {tasks})").alias("top")
    ).first()
    if found is None:
        return []
    limit = max(safe, found["n"] / tasks)
    return [t["item"] for t in found["top"] or [] if t["count"] > limit]


def _cut(df: DataFrame, is_large: Column, descending: bool, blocks: int) -> DataFrame:
    """Number the blocks of large groups, in their order; null in all other groups.

    Limits are quantiles over the large groups, so no block holds much more than one
    ``blocks``-th of their rows. A value met at several quantiles gets a block of its
    own, which is cut again by its own tiebreak, as are the rows with no value or NaN.
    """
    large = df.where(is_large).select("_at", "_tie")
    # Half shares find every value that has a whole one; limits are at whole shares.
    halves, rows = _quantiles(large, "_at", 2 * blocks)
    frequent = [v for v, times in Counter(halves).items() if times > 1]
    limits = sorted({*halves[1::2], *frequent, *(math.nextafter(v, math.inf) for v in frequent)})
    nan_block, null_block = len(limits) + 1, -1

    def numbered(rows: DataFrame) -> DataFrame:
        rows = _bucket(rows, "_at", limits, "_block")
        return rows.withColumn("_block", F.coalesce("_block", F.lit(null_block)))

    frequent_blocks = [limits.index(v) + 1 for v in frequent]
    held = numbered(large).where(
        F.col("_block").isin([nan_block, null_block, *frequent_blocks])
    )
    # Large integers and long decimals can share a double; such a block is not cut again.
    one_value = F.min("_at").eqNullSafe(F.max("_at"))
    tie = F.col("_tie").cast("double")
    ties = F.when(~F.isnan(tie), tie)
    found = held.groupBy("_block").agg(
        F.count("*").alias("n"), one_value.alias("one"), F.min(ties).alias("low"), F.max(ties).alias("high")
    ).collect()
    single = {row["_block"]: row for row in found if row["one"]}
    is_single = F.col("_block").isin(list(single)) if single else F.lit(False)
    df = numbered(df)
    if single:
        # A place is the block and how far the tiebreak is between its own least and greatest,
        # so that equal shares of all places cut each value by its own ties.
        every = [single.get(block) for block in range(null_block, nan_block + 1)]
        lows = F.lit([r["low"] if r and r["low"] is not None else 0.0 for r in every])
        spans = F.lit([(r["high"] - r["low"] if r and r["low"] is not None else 0.0) or 1.0 for r in every])
        at = F.col("_block") - null_block
        along = F.coalesce((tie - F.get(lows, at)) / F.get(spans, at), F.lit(0.0))
        place = F.col("_block") + along * 0.999
        shares = math.ceil(sum(r["n"] for r in single.values()) * blocks / rows)
        parts = sorted(set(_quantiles(held.where(is_single).select(place.alias("_place")), "_place", shares)[0]))
        df = _bucket(df.withColumn("_place", place), "_place", parts, "_sub").drop("_place")
    else:
        df = df.withColumn("_sub", F.lit(0))
    block = F.col("_block")
    if descending:
        # NaN comes first and nulls last.
        block = F.when(block == nan_block, -1).when(block == null_block, nan_block).otherwise(block)
    return df.withColumns({
        "_sub": F.when(is_large, F.when(is_single, F.coalesce("_sub", F.lit(0))).otherwise(0)),
        "_block": F.when(is_large, block),
    })


def _quantiles(df: DataFrame, column: str, parts: int) -> tuple[list[float], int]:
    """The limits of ``parts`` parts of near equal size, repeated where they coincide."""
    fractions = [i / parts for i in range(1, parts)] or [0.5]
    limits = F.percentile_approx(F.col(column).cast("double"), fractions, max(10_000, 5 * parts))
    found, rows = df.agg(limits, F.count("*")).first()
    return [v for v in found or [] if math.isfinite(v)], rows


def _bucket(df: DataFrame, column: str, limits: list[float], name: str) -> DataFrame:
    """Number of ``limits`` at or below ``column``; found by binary search on the JVM."""
    if not limits:
        nan = F.isnan(F.col(column).cast("double"))
        return df.withColumn(name, F.when(F.col(column).isNotNull(), nan.cast("int")))
    splits = [-math.inf, *limits, math.inf]
    bucketizer = Bucketizer(
        splits=splits, inputCol="_double", outputCol=name, handleInvalid="keep"
    )
    df = bucketizer.transform(df.withColumn("_double", F.col(column).cast("double")))
    return df.withColumn(name, F.col(name).cast("int")).drop("_double")
