"""Aggregations that need more than one built-in aggregate."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from rowtide.operators.ordered import Order, order_groups


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, fractions: dict[str, str]
) -> DataFrame:
    """Interpolated percentiles of a decimal column; ``fractions`` maps name to fraction.

    Equal values are counted first, and running counts find the two neighbours of each
    percentile, so no task holds all values of a group as the built-in aggregate does.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    groups = order_groups(counts, keys, Order(value), bounded_by=df).running_sum("_n", "_upto")
    running = groups.result().select(*keys, value, "_n", "_upto")

    # Per group, the places of the two neighbours and how far between them to go.
    at = {name: (F.sum("_n") - 1) * F.lit(Decimal(f)) for name, f in fractions.items()}
    places = counts.groupBy(*[F.col(k).alias(f"_group_{k}") for k in keys]).agg(
        *[F.floor(x).cast("bigint").alias(f"_{name}_low") for name, x in at.items()],
        *[F.ceil(x).cast("bigint").alias(f"_{name}_high") for name, x in at.items()],
        *[(x - F.floor(x)).cast("decimal(10,6)").alias(f"_{name}_rest") for name, x in at.items()],
    )
    if keys:
        match = [F.col(k).eqNullSafe(F.col(f"_group_{k}")) for k in keys]
        running = running.join(places, match).drop(*[f"_group_{k}" for k in keys])
    else:
        place = places.first()
        running = running.withColumns({c: F.lit(place[c]) for c in places.columns})

    ends = [f"_{name}_{end}" for name in fractions for end in ("low", "high")]
    covers = {e: (F.col("_upto") > F.col(e)) & (F.col("_upto") - F.col("_n") <= F.col(e)) for e in ends}
    found = running.where(reduce(Column.__or__, covers.values())).groupBy(*keys).agg(
        *[F.max(F.when(covers[e], F.col(value))).alias(e) for e in ends],
        *[F.max(f"_{name}_rest").alias(f"_{name}_rest") for name in fractions],
    )

    def between(name: str) -> Column:
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        return (low + (high - low) * F.col(f"_{name}_rest")).alias(name)

    return found.select(*keys, *[between(name) for name in fractions])


def totals_by(
    df: DataFrame,
    group: Callable[[DataFrame], GroupedData],
    finest: list[str],
    sums: dict[str, Column],
) -> DataFrame:
    """Rollup, cube or grouping sets of sums, computed from sums at the finest grain.

    Spark repeats each input row once per grouping set, so it is given the few rows of
    the finest grain instead of the table. ``sums`` holds the counts and sums to take
    there; ``group`` applies ``rollup``, ``cube`` or ``groupingSets`` to the result.
    """
    base = df.groupBy(*finest).agg(*[c.alias(name) for name, c in sums.items()])
    totals = [F.sum(name).alias(name) for name in sums]
    return group(base).agg(*totals, F.grouping_id().alias("level"))


def histogram(
    df: DataFrame, keys: list[str], value: str, low: float, width: float, bins: int
) -> DataFrame:
    """Count values per key and equal-width bin.

    Values outside the bins fall into the first or last one; nulls and NaN into none.
    """
    number = F.col(value).cast("double")
    place = F.least(F.greatest((number - low) / width, F.lit(0.0)), F.lit(bins - 1.0))
    known = df.where(number.isNotNull() & ~F.isnan(number))
    binned = known.select(*keys, F.floor(place).cast("bigint").alias("bin"))
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
