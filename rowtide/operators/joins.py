"""Joins on time: ranges, nearest earlier rows, and counts within a range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.functions.columns import micros, timestamp_from_micros
from rowtide.operators.ordered import Order, order_groups


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    width_micros: int,
) -> DataFrame:
    """Pairs of equal ``keys`` with ``right_ts`` in [``left_ts`` - width, ``left_ts``].

    Time is cut into buckets as wide as the range, so a match lies in the left row's
    bucket or the one before. Key and bucket make it an equi join, which Spark shuffles
    and, with adaptive execution, splits where one key and bucket is large. Column
    names other than ``keys`` must differ between the sides.
    """
    bucket = F.floor(micros(left_ts) / width_micros)
    left = left.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket)))
    right = right.withColumn("_bucket", F.floor(micros(right_ts) / width_micros))
    age = micros(left_ts) - micros(right_ts)
    return left.join(right, [*keys, "_bucket"]).where(age.between(0, width_micros)).drop("_bucket")


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    values: list[str],
    tiebreak: str,
) -> DataFrame:
    """Each left row with ``values`` of the latest right row not after it, or nulls.

    Of right rows at one time, the one with the largest ``tiebreak`` (an integer below
    2**62) counts. Both sides are stacked and each left row takes the last right row
    before it: one shuffle, and no pairs. As in any join, a null key matches nothing.
    """
    known = _with_keys(right, [*keys, right_ts]).select(
        *keys,
        micros(right_ts).alias("_ts"),
        F.col(tiebreak).cast("bigint").alias("_step"),
        F.struct(*values).alias("_right"),
    )
    rows = known.unionByName(_boxed(left, keys, left_ts, 1 << 62), allowMissingColumns=True)
    groups = order_groups(rows, keys, Order("_ts", tiebreak="_step")).last_known("_right", "_found")
    found = groups.result().where("_left is not null")
    return found.select(*keys, "_left.*", *[F.col("_found")[v].alias(v) for v in values])


def _with_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    return reduce(lambda rows, c: rows.where(F.col(c).isNotNull()), columns, df)


def _boxed(left: DataFrame, keys: list[str], ts: str, after: int) -> DataFrame:
    """Left rows as one struct column, placed after the other rows of their time.

    Their order among themselves does not matter; the hash lets a crowded time be cut.
    """
    names = [c for c in left.columns if c not in keys]
    boxed = left.select(*keys, micros(ts).alias("_ts"), F.struct(*names).alias("_left"))
    return boxed.withColumn("_step", F.pmod(F.xxhash64("_left"), F.lit(1 << 31)) + F.lit(after))


def _range_steps(
    right: DataFrame, keys: list[str], ts: str, width_micros: int, value: str
) -> DataFrame:
    """Per key and time, counts and sums to add then and to take off after the width."""
    per_time = (
        _with_keys(right, [ts])
        .groupBy(*keys, micros(ts).alias("_ts"))
        .agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"))
    )
    opened = F.struct("_ts", "_n", "_sum", F.lit(-1).cast("bigint").alias("_step"))
    closed = F.struct(
        (F.col("_ts") + F.lit(width_micros).cast("bigint")).alias("_ts"),
        (-F.col("_n")).alias("_n"),
        (-F.col("_sum")).alias("_sum"),
        F.lit(1 << 31).alias("_step"),
    )
    return per_time.select(*keys, F.inline(F.array(opened, closed)))


def _sum_steps(rows: DataFrame, keys: list[str], sources: list[DataFrame]) -> DataFrame:
    """Running sums of steps; a step stems from one row of ``sources`` or from several."""
    bound = reduce(DataFrame.unionByName, [source.select(*keys) for source in sources])
    groups = order_groups(rows, keys, Order("_ts", tiebreak="_step"), bounded_by=bound)
    groups = groups.running_sum("_n", "_count").running_sum("_sum", "_total")
    count = F.coalesce("_count", F.lit(0)).cast("bigint")
    total = F.when(count > 0, F.col("_total"))
    return groups.result().withColumns({"range_count": count, "range_sum": total})


def count_in_range(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    width_micros: int,
    value: str,
) -> DataFrame:
    """Each left row with the count and sum of right rows a range join would pair it with.

    A right row adds to a running sum at its time and is taken off after the width; a
    left row reads the sum in between. The work grows with the rows, not the pairs.
    Right rows of one time are added up before the shuffle. ``value`` must be exact
    (integer or decimal), since what is added is subtracted again. A null key matches nothing.
    """
    steps = _range_steps(_with_keys(right, keys), keys, right_ts, width_micros, value)
    asked = _boxed(left, keys, left_ts, 0)
    found = _sum_steps(steps.unionByName(asked, allowMissingColumns=True), keys, [left, right, right])
    return found.where("_left is not null").select(*keys, "_left.*", "range_count", "range_sum")


def trailing_sum(
    df: DataFrame, keys: list[str], ts: str, value: str, width_micros: int
) -> DataFrame:
    """One row per key and time: count and sum of ``value`` in [time - width, time].

    Equals a RANGE frame, without sending a whole group to one task.
    """
    found = _sum_steps(_range_steps(df, keys, ts, width_micros, value), keys, [df, df])
    return found.where("_step < 0").select(
        *keys, timestamp_from_micros("_ts").alias(ts), "range_count", "range_sum"
    )
