"""The event envelope, and event logs derived from plain tables.

An event is (aggregate_kind, aggregate_id, kind, position, data, metadata): a stream is one (aggregate_kind,
aggregate_id), position is dense and global, data is JSON whose fields depend on kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("aggregate_kind", T.StringType(), False),
        T.StructField("aggregate_id", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("position", T.LongType(), False),
        T.StructField("data", T.StringType(), False),
        T.StructField("metadata", T.StringType(), True),
    ]
)
STREAM = ["aggregate_kind", "aggregate_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount) -> F.Column:
    return F.round(amount * 100).cast("long")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log of user streams, its payload in typed columns amount_cents and k, and at_millis of its metadata."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("user").alias("aggregate_kind"),
        F.col("user_id").cast("string").alias("aggregate_id"),
        F.col("event_type").alias("kind"),
        F.col("event_id").alias("position"),
        cents(F.col("value")).alias("amount_cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_millis"),
    )


def enveloped(typed: DataFrame, payload: list[str], metadata: list[str]) -> DataFrame:
    """Typed columns packed into JSON data and metadata."""
    return typed.select("aggregate_kind", "aggregate_id", "kind", "position", F.to_json(F.struct(*payload)).alias("data"), F.to_json(F.struct(*metadata)).alias("metadata"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and lines as a log of order streams, without positions: phase 0 is order.placed, phase 1 order.line_added.

    Payload: customer_id, total_cents, status; part_key, supplier_key, line_number, quantity, price_cents, discount, tax, flag, line_status, ship_day.
    """
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.lit(0).alias("phase"), F.lit("order.placed").alias("kind"),
        F.col("o_custkey").alias("customer_id"), cents(F.col("o_totalprice")).alias("total_cents"), F.col("o_orderstatus").alias("status"), day("o_orderdate").alias("order_day"),
    )
    i = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.lit(1).alias("phase"), F.lit("order.line_added").alias("kind"),
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supplier_key"), F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").cast("long").alias("quantity"), cents(F.col("l_extendedprice")).alias("price_cents"), cents(F.col("l_discount")).alias("discount"), cents(F.col("l_tax")).alias("tax"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"), day("l_shipdate").alias("ship_day"),
    )
    return o.unionByName(i, allowMissingColumns=True)


#: Order of the lines of an order in the log: line numbers repeat, whole rows don't.
LINE_ORDER = ["phase", "line_number", "part_key", "supplier_key", "quantity", "price_cents", "discount", "tax", "flag", "line_status", "ship_day"]


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams: kind is the role, version the turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.lit("conversation").alias("aggregate_kind"), F.col("conv_id").cast("string").alias("aggregate_id"), F.col("role").alias("kind"), F.col("turn").alias("version"), F.char_length("text").cast("long").alias("n_chars"))
