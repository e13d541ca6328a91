"""Tables that cut lineage: written once into the shared folder and read again.

The folder lies below spark.checkpoint.dir, which driver and executors share. Where that setting is absent (tests on
one machine) a folder beside the warehouse serves.
"""

from __future__ import annotations

import atexit
import itertools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_serial = itertools.count()
_folders: dict[str, SparkSession] = {}
_within: ContextVar[str | None] = ContextVar("_within", default=None)


def _path(spark: SparkSession, address: str):
    """The Hadoop path of an address and its file system; an address without scheme is one of the session's default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(address)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(p), system


def folder(spark: SparkSession) -> str:
    """This application's folder, with its scheme; it goes when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        spark.conf.set("spark.checkpoint.dir", top)
    path = _path(spark, f"{top.rstrip('/')}/tessera-{spark.sparkContext.applicationId}")[0].toString()
    if path not in _folders:
        _folders[path] = spark
        atexit.register(remove, spark, path)
    return path


def new_path(spark: SparkSession, what: str) -> str:
    return f"{_within.get() or folder(spark)}/{what}-{next(_serial)}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Hadoop's file system, whatever its scheme; silent if the session has ended."""
    try:
        p, system = _path(spark, path)
        system.delete(p, True)
    except Exception:  # at exit the gateway may be gone
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as they are now: later reads agree, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make()``, written; the tables that it wrote on its way go."""
    path = new_path(spark, what)
    before = _within.set(f"{path}-parts")
    try:
        df = make()
        df.write.option("compression", "zstd").parquet(path)
    finally:
        remove(spark, _within.get())
        _within.reset(before)
    return spark.read.schema(df.schema).parquet(path)
