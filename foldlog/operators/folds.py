"""Ordered folds of events in closed form: aggregates and window expressions instead of a loop over events.

All windows order by position, which is unique, and have an explicit row frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(*keys: str):
    """All rows of a key up to the current one."""
    return Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def total_when(condition: Column, amount: Column | str) -> Column:
    amount = F.col(amount) if isinstance(amount, str) else amount
    return F.coalesce(F.sum(F.when(condition, amount)), F.lit(0)).cast("long")


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def last_when(condition: Column, value: Column | str) -> Column:
    """The value of the last row of a group that meets the condition: mergeable, no sort."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max_by(value, F.when(condition, F.col("position")))


def clamped(df: DataFrame, change: Column, *keys: str, name: str = "balance") -> DataFrame:
    """The fold b = max(0, b + change) after each row: the running sum less its running minimum below 0."""
    w = running(*keys)
    df = df.withColumn("__sum", F.sum(change).over(w))
    return df.withColumn(name, (F.col("__sum") - F.least(F.min("__sum").over(w), F.lit(0))).cast("long")).drop("__sum")


def segmented(df: DataFrame, is_reset: Column, *keys: str, name: str = "segment") -> DataFrame:
    """Numbers the runs that begin with a row of is_reset (0 before the first)."""
    return df.withColumn(name, F.sum(F.when(is_reset, 1).otherwise(0)).over(running(*keys)))


def clamped_with_resets(df: DataFrame, change: Column, is_reset: Column, *keys: str, name: str = "balance") -> DataFrame:
    """As clamped(), but a row of is_reset sets the balance to its change."""
    df = segmented(df, is_reset, *keys, name="__segment")
    return clamped(df, change, *keys, "__segment", name=name).drop("__segment")


def as_of(value: Column, *keys: str) -> Column:
    """The last value that isn't null up to and with the current row."""
    return F.last(value, ignorenulls=True).over(running(*keys))


def known(is_defining: Column, *keys: str) -> Column:
    """Whether a defining row has come, the current one included."""
    return F.max(F.when(is_defining, 1).otherwise(0)).over(running(*keys)) == 1


def members(df: DataFrame, element: str, op: Column, *keys: str) -> DataFrame:
    """Elements of a set per key: those whose last operation is add. op is add, remove or null."""
    ops = df.withColumn("__op", op).where(F.col("__op").isNotNull())
    return ops.groupBy(*keys, element).agg(F.max_by("__op", "position").alias("__last")).where(F.col("__last") == "add").drop("__last")


def effective(op: Column, *keys: str) -> Column:
    """Whether a removal finds its element: the operation before it on the same element is add."""
    return F.lag(op).over(Window.partitionBy(*keys).orderBy("position")) == "add"


def final(df: DataFrame, values: list[str], *keys: str) -> DataFrame:
    """Values at the greatest position of each key."""
    return df.groupBy(*keys).agg(*[F.max_by(v, "position").alias(v) for v in values])
