"""Weekday arithmetic and instalments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 1970-01-01 was a Thursday: so many days after a Monday.
DAYS_AFTER_MONDAY = 3


def _weekdays_before(day: Column) -> Column:
    """Weekdays from a fixed Monday up to but not including a date: whole weeks and the rest."""
    days = F.unix_date(day.cast("date")) + DAYS_AFTER_MONDAY
    return (5 * F.floor(days / 7) + F.least(F.pmod(days, F.lit(7)), F.lit(5))).cast("bigint")


def business_days(start: Column, end: Column) -> Column:
    """Weekdays from the earlier date up to but not including the later one.

    Negative where ``end`` is the earlier one; null where a date is.
    """
    return _weekdays_before(end) - _weekdays_before(start)


def instalments(df: DataFrame) -> DataFrame:
    """Split ``cents`` of each ``id`` into equal ``parts``, the first ones taking the odd cents.

    Rows where cents or parts are null, or parts are below 1, give none.
    """
    known = df.where("cents IS NOT NULL AND parts >= 1")
    numbered = known.withColumn("instalment", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    due = F.expr("cents DIV parts") + F.when(F.col("instalment") <= F.expr("cents % parts"), 1).otherwise(0)
    return numbered.select("id", F.col("instalment").cast("int").alias("instalment"), due.cast("bigint").alias("due_cents"))
