"""The run loop of a work queue as a stream: requests and results come in, commands to fetch go out.

Each item has a shard of state: its status, the attempts made and when the next is due. A failed attempt is
made again after a wait that doubles each time, by a timer on event time; a finished item is remembered for a
while, so that it isn't taken on twice, and then forgotten by the same timer. What an item goes through
depends on the times of its rows alone, not on how they are cut into batches.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from narrata.sources.shared import move, scratch

ROWS = "item string, at timestamp, seq long, status_code int"
COMMANDS = "item string, record string, attempt int, at_ms long"
RUNNING, WAITING, ENDED = "running", "waiting", "ended"
#: The event time, in seconds, after which nothing is due.
END_S = 32_472_144_000

#: State in RocksDB, closed when a task commits; no batches without rows.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Item(StatefulProcessor):
    """One item's life: fetch commands, and how it ended."""

    def __init__(self, max_attempts: int = 3, wait_ms: int = 60_000, remember_ms: int = 86_400_000):
        self.max_attempts, self.wait_ms, self.remember_ms = max_attempts, wait_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # due: when a waiting item runs again, and when an ended one is forgotten.
        self.state = handle.getValueState("item", "status string, attempt int, due long, timer long")

    def passed(self, item: str, state: tuple | None, now: int) -> tuple[tuple | None, list[Row]]:
        """The state at a time, and what was due before it."""
        if state is None or state[0] == RUNNING or state[2] > now:
            return state, []
        if state[0] == ENDED:
            return None, []
        return (RUNNING, state[1] + 1, 0), [Row(item=item, record="fetch", attempt=state[1] + 1, at_ms=state[2])]

    def taken(self, item: str, state: tuple | None, now: int, status: int | None) -> tuple[tuple | None, list[Row]]:
        """The state after a request (without a status) or a result, and what it says."""
        said = lambda record, attempt: [Row(item=item, record=record, attempt=attempt, at_ms=now)]
        if status is None:
            return (state, []) if state else ((RUNNING, 1, 0), said("fetch", 1))
        if state is None or state[0] != RUNNING:
            return state, said("stray", 0)
        attempt = state[1]
        if 200 <= status <= 299:
            return (ENDED, attempt, now + self.remember_ms), said("completed", attempt)
        if attempt >= self.max_attempts:
            return (ENDED, attempt, now + self.remember_ms), said("failed", attempt)
        return (WAITING, attempt, now + self.wait_ms * 2 ** (attempt - 1)), []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was, item = self.state.get(), key[0]
        state = was and tuple(was)[:3]
        for r in sorted(rows, key=lambda r: (r.at_ms, r.seq)):
            state, records = self.passed(item, state, r.at_ms)
            yield from records
            state, records = self.taken(item, state, r.at_ms, r.status_code)
            yield from records
        self.keep(was and was[3], state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        was = self.state.get()
        if was is not None and was[3] == expiredTimerInfo.getExpiryTimeInMs():
            state, records = self.passed(key[0], tuple(was)[:3], timerValues.getCurrentWatermarkInMs())
            yield from records
            self.keep(None, state)

    def keep(self, timer: int | None, state: tuple | None) -> None:
        """Stores the state, with its timer set anew."""
        due = state[2] if state and state[0] != RUNNING else None
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if due and timer != due:
            self.handle.registerTimer(due)
        if state is None:
            self.state.clear()
        else:
            self.state.update((*state, due or 0))

    def close(self) -> None:
        pass


def commands(rows: DataFrame, late: str = "0 seconds", **limits: int) -> DataFrame:
    """(item, record, attempt, at_ms) for a stream of ROWS.

    A row without status_code asks for an item, one with it is the result of its running attempt. record is
    fetch (a command for an attempt), completed, failed (no attempts left) or stray (a result nobody waits for).
    An item asked for again while it is known gives nothing. Rows of an item are taken by at and seq; rows
    that come later than the watermark allows still count, at their own time. Rows without an item or a
    time are left out. limits: max_attempts, wait_ms, remember_ms.
    """
    timed = rows.withWatermark("at", late)
    # One condition on both, which stays above the watermark: rows without an item still move that on.
    plain = timed.where("length(item || cast(at AS string)) >= 0").select("item", F.unix_millis("at").alias("at_ms"), F.coalesce("seq", F.lit(0)).alias("seq"), "status_code")
    return plain.groupBy("item").transformWithState(Item(**limits), COMMANDS, "Append", "EventTime")


@contextlib.contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(spark: SparkSession, source: str, out: str, checkpoint: str, late: str = "0 seconds", **limits: int) -> StreamingQuery:
    """Takes what is new in a folder of Parquet files of ROWS through the loop, as one micro-batch, and stops."""
    with settings(spark):
        found = commands(spark.readStream.schema(ROWS).parquet(source), late, **limits)
        return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replay(rows: DataFrame, n: int, **limits: int) -> DataFrame:
    """The commands of a loop over rows (item, at, seq, status_code, batch) in batches 0 to n - 1, until all is due.

    A start for each batch, on one checkpoint, and one more after the end of time. Batches should ascend with
    at. A start that breaks off is made again from the checkpoint, without loss or repetition.
    """
    spark = rows.sparkSession
    folder = scratch(spark, "loop")
    cut, feed, out, checkpoint = (f"{folder}/{name}" for name in ("cut", "feed", "commands", "checkpoint"))
    nothing = [F.lit(None).cast("string").alias("item"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("int").alias("status_code"), F.col("id").alias("batch")]
    empty = spark.range(0, n, 1, 1).select(*nothing)
    ticks = spark.range(n - 1, n + 1, 1, 1).select(*nothing).withColumn("at", F.timestamp_seconds(F.lit(END_S)))
    kept = rows.select("item", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("status_code").cast("int").alias("status_code"), F.col("batch").cast("long").alias("batch"))
    kept.where(F.col("batch").between(0, n - 1)).unionByName(empty).unionByName(ticks).write.partitionBy("batch").parquet(cut)
    for b in range(n + 1):
        move(spark, f"{cut}/batch={b}", f"{feed}/batch={b}")
        start(spark, feed, out, checkpoint, **limits).awaitTermination()
    return spark.read.schema(COMMANDS).parquet(out)
