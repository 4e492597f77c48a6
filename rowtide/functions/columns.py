"""Column helpers shared by operators and queries."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def money(column: str) -> Column:
    """Exact hundredths: sums then do not depend on the order of addition."""
    return F.col(column).cast("decimal(15,2)")


def cents(column: str) -> Column:
    """Whole hundredths of a column that holds hundredths; integers are cheap to add."""
    return F.rint(F.col(column) * 100).cast("bigint")


def revenue() -> Column:
    """Discounted price of a line, in units of 1/10000."""
    return cents("l_extendedprice") * (100 - cents("l_discount"))


def exact_sum(units: Column, scale: int) -> Column:
    """Sum of integer ``units`` of 10**-scale as a decimal.

    Adding decimals costs several times as much as adding integers, and one integer sum
    could overflow, so the upper bits and the lower 22 bits are added up apart. Both
    sums fit for 2**41 rows of up to 2**43 units each.
    """
    upper = F.sum(F.shiftright(units, 22)).cast("decimal(20,0)")
    lower = F.sum(units.bitwiseAND((1 << 22) - 1)).cast("decimal(20,0)")
    unit = F.lit(Decimal(1).scaleb(-scale))
    return ((upper * F.lit(Decimal(1 << 22)) + lower) * unit).cast(f"decimal(38,{scale})")


def micros(column: str | Column) -> Column:
    """Whole microseconds since 1970 of a timestamp without time zone.

    Spark computes the difference in the session time zone; sessions here use UTC.
    """
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), column)


def timestamp_from_micros(column: str | Column) -> Column:
    return F.timestamp_add("MICROSECOND", column, F.expr(EPOCH))
