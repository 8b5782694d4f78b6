"""Version checks and lifecycle outcomes for many streams at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_versions(wanted: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, expected) against heads (keys, actual): ok if equal; a null means that there is no stream."""
    return wanted.join(heads, keys, "left").withColumn("outcome", F.when(F.col("expected").eqNullSafe(F.col("actual")), F.lit("ok")).otherwise(F.lit("conflict")))


def lifecycle(wanted: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome of create, update and upsert commands for streams that exist (heads) or don't."""
    there = F.col("__there").isNotNull()
    outcome = F.when(F.col("command") == "create", F.when(there, F.lit("already_exists")).otherwise(F.lit("created"))).when(F.col("command") == "update", F.when(there, F.lit("updated")).otherwise(F.lit("not_found"))).otherwise(F.when(there, F.lit("updated")).otherwise(F.lit("created")))
    return wanted.join(heads.select(*keys).withColumn("__there", F.lit(1)), keys, "left").withColumn("outcome", outcome).drop("__there")
