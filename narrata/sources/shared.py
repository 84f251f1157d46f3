"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one in force, else spark.checkpoint.dir, else (local sessions only) a temporary one."""
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame, computed once, written as Parquet to the shared folder and read again; that cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder of the shared file system; done already counts as done."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.exists(b) and not fs.rename(a, b):
        raise OSError(f"{source} can't become {target}")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def forget(spark: SparkSession, path: str) -> None:
    """Removes what is at the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def with_files(spark: SparkSession, table: str) -> None:
    """Has a table's catalog entry dropped when the application ends, with the files written before."""
    _TABLES.append((spark, table))


_TABLES: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget() -> None:
    for spark, table in _TABLES:
        with contextlib.suppress(Exception):  # the context may have ended
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):
            forget(spark, path)
