"""Dense positions in a global order, without sorting in one task; and rows of a key kept in one task, in order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, about; sampled rows for each bound between ranges.
ROWS, PER_BOUND = 4_000_000, 16


def dense_positions(df: DataFrame, key: str, order: list, name: str = "position", start=0) -> DataFrame:
    """df with name: start, start + 1, ... by (key, order). key is a whole number; rows of one key stay in one range. start may be a scalar subquery.

    Bounds between ranges come from a sample of keys, PER_BOUND for each, which is all that the driver sees; a range
    has about ROWS rows, whatever the size of df. Keys find their range in two levels of the square root of the bounds.
    A task numbers the rows of a range, and a table with a row for each range tells how many are before it.
    """
    spark = df.sparkSession
    total = df.count()
    side = math.ceil(math.sqrt(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total / ROWS)))
    share = min(1.0, PER_BOUND * side * side / max(total, 1))
    keys = (df.select(key) if share == 1 else df.select(key).sample(share, 1)).where(F.col(key).isNotNull()).toArrow().column(0).sort().to_pylist()
    bounds = sorted({keys[i * len(keys) // (side * side)] for i in range(1, side * side)}) if keys else []
    tops = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    longs = lambda x: F.array(*[F.lit(b).cast("long") for b in x]).cast("array<long>")
    below = lambda x: F.size(F.filter(x, lambda b: b <= F.coalesce(F.col(key), F.lit(-(1 << 63)))))
    inner = spark.createDataFrame([(i, t[1:]) for i, t in enumerate(tops, 1)], "__top int, __inner array<long>")  # as many rows as there are bounds in the first level
    rows = df.withColumn("__top", below(longs([t[0] for t in tops]))).join(F.broadcast(inner), "__top", "left")
    rows = rows.withColumn("__range", F.col("__top") * side + F.when(F.col("__inner").isNull(), F.lit(0)).otherwise(below(F.col("__inner")))).drop("__top", "__inner")
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = rows.withColumn("__row", F.row_number().over(Window.partitionBy("__range").orderBy(F.asc_nulls_first(key), *order)))
    start = F.lit(start) if isinstance(start, int) else start
    out = numbered.join(F.broadcast(offsets), "__range")  # as many rows as ranges
    return out.withColumn(name, (F.col("__row") - 1 + F.col("__before") + start).cast("long")).drop("__row", "__range", "__before")


def together(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df sorted by (key, order) within partitions, of which one has all rows of a key: for Python code that goes through them.

    Rows are dealt by a hash of the key. Dealt by the key itself, this step would be left out where a join or an aggregate
    has dealt rows so before, and adaptive execution, which sees no need for that in what Python reads, may cut its
    partitions: a join that becomes a broadcast reads by mapper, a skewed one by parts.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)
