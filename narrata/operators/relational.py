"""Relational helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes, up to which a side is broadcast.
FEW, FEW_BYTES = 100_000, 32 << 20
#: The same for a side whose keys many rows lack: a shuffle would send those to one task.
FEW_OUTER, FEW_OUTER_BYTES = 1_000_000, 64 << 20


def few(df: DataFrame, row_bytes: str = "0", rows: int = FEW, most_bytes: int = FEW_BYTES) -> DataFrame:
    """The frame with a broadcast hint if it has few rows and bytes; else as it is, for Spark to plan.

    row_bytes is SQL for the bytes of a row's texts and arrays.
    """
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.expr(row_bytes).cast("long") + 32)).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most_bytes else df


def most_of_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """The rows that have their group's greatest value: all of them, where several do."""
    best = df.groupBy(group).agg(F.max(value).alias("_best"))
    return df.join(best, group).where(F.col(value) == F.col("_best")).drop("_best")


def share_of_total(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys, and their percentage of all rows (null if there are none)."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("percent", F.round(F.try_divide(F.col("n") * 100.0, F.col("_all")), 9)).drop("_all")
