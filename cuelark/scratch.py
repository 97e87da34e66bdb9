"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees. Only a local session (tests) may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cuelark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cuelark-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def drop_now(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's setting to remove a query's shuffle files when it has ended; without it they stay until the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: For each settled() under way, the folders that stored() has made since.
_under_way: list[list[str]] = []


def stored(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: its lineage ends there, and an executor that is lost loses nothing of it.

    The shuffle files of the write go with it; no later query reads them, as each write plans its own."""
    spark = df.sparkSession
    path, before = shared_dir(spark), spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)
    drop_at_exit(spark, path)
    if _under_way:
        _under_way[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled[T: (DataFrame, tuple[DataFrame, ...])](build: Callable[[], T]) -> T:
    """The table, or tuple of tables, that build() gives, stored; what build stored on its way is dropped, as nothing but these tables reads it."""
    held: list[str] = []
    _under_way.append(held)
    try:
        out = build()
    finally:
        _under_way.pop()
    tables = out if isinstance(out, tuple) else (out,)
    result = tuple(map(stored, tables))
    for path in held:
        drop_now(tables[0].sparkSession, path)
    return result if isinstance(out, tuple) else result[0]
