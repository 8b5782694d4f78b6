"""Tables written to the shared checkpoint folder, to cut lineage and to be read more than once."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

from pyspark.sql import DataFrame

_written: dict[str, object] = {}
#: With this setting Spark removes a query's shuffle files when it ends, not when the driver collects its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine where the setting is missing and the master is local."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        place = tempfile.mkdtemp(prefix="checkpoints")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def stored(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df as a Parquet table in the checkpoint folder, read again; removed when the driver exits, if not before.

    done: results of stored() that only df has read; they are removed once df is written.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    if not _written:
        atexit.register(clear)
    _written[path] = spark
    drop(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that stored() has written; anything else is let be. What still reads them fails."""
    for table in tables:
        _remove(table.__dict__.get("stored_at"))


def swept(df: DataFrame) -> DataFrame:
    """df, a result of stored(), after shuffle files have gone that only finished queries have read.

    Executors keep them until the driver collects the plans that made them, and a driver with memory to spare may do so
    only when a large table's shuffles have filled the disks.
    """
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def _remove(path: str | None) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear() -> None:
    """Removes all that stored() has written."""
    for path in list(_written):
        _remove(path)
