"""Samples of exact size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bottom_k(df: DataFrame, strata: list[str], key: list[str], k: int, salt: str = "") -> DataFrame:
    """k rows of each stratum (all, if it has fewer): those whose key has the smallest hash.

    The hash is of the key and the salt alone, so the sample is the same on any partitioning, grows with k by
    rows added, and is a fair draw. Every task keeps k rows of a stratum before the shuffle, so a stratum of
    any size sends k rows a task. Rows of equal key tie, and the order of all columns decides; null parts of
    a key or a stratum count as values.
    """
    if k < 0:
        raise ValueError("a sample can't be negative")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key]
    drawn = df.withColumn("_draw", F.md5(F.concat_ws("\x01", F.lit(salt), *parts)))
    order = Window.partitionBy(*strata).orderBy("_draw", *df.columns)
    return drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_draw", "_rank")
