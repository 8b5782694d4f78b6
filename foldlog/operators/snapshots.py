"""Snapshots of fold states: policies, monotone offers, and resuming a fold from a stored state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Stores when so many events have come since the last snapshot; None: never. Loading is always allowed."""

    events: int | None

    def due(self, since: int) -> bool:
        return self.events is not None and since >= self.events


class Offer(Enum):
    """What became of an offered snapshot; true if it was stored."""

    STORED, DECLINED = "stored", "declined"

    def __bool__(self) -> bool:
        return self is Offer.STORED


always, never = Policy(1), Policy(None)


def every(n: int) -> Policy:
    return Policy(n)


def stored_points(rows: DataFrame, policy: Policy, *keys: str) -> DataFrame:
    """The rows (one for each event) after which the policy stores, if it is asked after each."""
    if policy.events is None:
        return rows.where(F.lit(False))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    return rows.withColumn("__n", n).where(F.col("__n") % max(policy.events, 1) == 0).drop("__n")


def merge(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Stored snapshots after offers of new ones, with offer: stored if its position is greater, else declined; none without one."""
    o = old.select(*keys, F.struct("position", *values).alias("__old"))
    n = new.select(*keys, F.struct("position", *values).alias("__new"))
    both = o.join(n, keys, "full")
    newer = F.col("__new").isNotNull() & (F.col("__old").isNull() | (F.col("__new.position") > F.col("__old.position")))
    offer = F.when(F.col("__new").isNull(), F.lit("none")).when(newer, F.lit("stored")).otherwise(F.lit("declined"))
    return both.select(*keys, F.when(newer, F.col("__new")).otherwise(F.col("__old")).alias("__kept"), offer.alias("offer")).select(*keys, "__kept.*", "offer")


def resume(base: DataFrame, tail: DataFrame, keys: list[str], combine: dict[str, Callable[[str], Column]]) -> DataFrame:
    """State of mergeable folds from a snapshot and the fold of the events after it."""
    return base.unionByName(tail).groupBy(*keys).agg(*[f(c).alias(c) for c, f in combine.items()])
