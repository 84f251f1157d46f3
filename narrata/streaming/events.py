"""Event streams: deduplicated queues, windowed counts, sessions, and job states kept by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet", files_per_batch: int = 64) -> DataFrame:
    """A folder's Parquet files as a stream, with ts as a timestamp of the session's zone."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and their value by hour and type."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("hour"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no pause of gap or more."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")
    )


def first_seen(items: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Items whose key was not seen within the watermark: an enqueue that ignores repeats."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def job_states(changes: DataFrame, max_attempts: int = 3) -> DataFrame:
    """For each job, its attempts and status after each batch of outcomes (job_id, outcome)."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, status = state.get if state.exists else (0, "NEW")
        for batch in batches:
            for outcome in batch.sort_values("ts")["outcome"]:
                if status in ("SUCCEEDED", "DEADLETTER"):
                    break
                attempts += 1
                status = "SUCCEEDED" if outcome == "SUCCEEDED" else "DEADLETTER" if attempts >= max_attempts else "NEW"
        state.update((attempts, status))
        yield pd.DataFrame({"job_id": [key[0]], "attempts": [attempts], "status": [status]})

    return changes.groupBy("job_id").applyInPandasWithState(advance, "job_id long, attempts int, status string", "attempts int, status string", "update", GroupStateTimeout.NoTimeout)
