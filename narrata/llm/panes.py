"""Hourly panes of a stream, with revisions when late rows change what was written.

Rows come in batches; the watermark W of a batch is the largest event time of all batches before it. A pane
is a kind and an hour. Once W has passed a grace time after its end it is due and its totals are written;
rows that come after that, before the pane closes, have the old totals taken back and the new ones written.
Rows of a closed pane are written as late, and change nothing.

The stream keeps a shard of state for each kind and day. It has the totals of its hours, the set of hours
with rows since they were last looked at, and one timer, set anew to the earliest deadline of its hours: now
for a written hour with new rows, the end of grace for an unwritten one, closing for the others. All is
written when the timer fires, after the batch's rows.

Before the shuffle each task adds up its rows by kind and hour, so a shard gets a row for each hour and task
however many rows a kind has. Late rows are told apart there too: they need no state, so they are spread
over shards of their own.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from narrata.llm.common import ready, scratch

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
#: Microseconds added to event times, so that the watermark's first value, 0, lies before every one of them.
SHIFT_US = 6_000 * 366 * DAY_US
#: The event time, with its shift, that ends a stream.
END_US = 3 * SHIFT_US
#: Shards of a kind and day that late rows are spread over, and panes that a task adds up before it passes them on.
SPREAD, PANES = 64, 100_000

FEED = "click_id long, kind string, event_us long, hour long, cents long"
RECORDS = "batch long, record string, kind string, hour long, click_id long, n_rows long, cents long"
PARTIAL = "kind string, day long, part long, hour long, click_id long, n_rows long, cents long"


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp's own clock, whatever the session's zone."""
    return F.expr(f"cast(cast(cast({column} as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as decimal(20, 6)) * 1000000 as long)")


def batched(clicks: DataFrame, n: int = 10) -> DataFrame:
    """(batch, click_id, kind, event_us, hour, cents): each click once, with its batch and its event time in it.

    Rows without ts or click_id are left out; of rows with one click_id the smallest (ts, arrived_at, kind, value)
    stays. Without arrived_at a row arrives when it happens. A null kind is `none`, a null value 0; a value
    that is no number counts 0.
    """
    one = (
        clicks.where("ts is not null and click_id is not null")
        .groupBy(F.col("click_id").alias("click_id"))
        .agg(F.min(F.struct("ts", "arrived_at", "kind", "value")).alias("r"))
        .select("click_id", "r.*")
    )
    day = F.expr("cast(unix_date(cast(coalesce(arrived_at, ts) as date)) as long)")
    late = F.expr("greatest(0, pmod(crc32(cast(cast(click_id as string) as binary)), 30) - 23)")
    rows = one.withColumn("day", day).withColumn("q", F.pmod("day", F.lit(n))).withColumn("us", micros("ts") - (F.col("day") - F.col("q")) * DAY_US)
    return rows.select(
        F.least(F.lit(n - 1), F.col("q") + late).cast("long").alias("batch"),
        "click_id",
        F.coalesce("kind", F.lit("none")).alias("kind"),
        F.col("us").alias("event_us"),
        F.expr(f"(us - pmod(us, {HOUR_US})) div {HOUR_US}").alias("hour"),
        F.expr("coalesce(floor(100 * value + 0.5), 0)").cast("long").alias("cents"),
    )


def write_batches(rows: DataFrame, n: int, folder: str) -> list[int | None]:
    """Writes folder/batch=0 and on; each has one row of no click at least. Returns W of each batch, None before any row.

    The row of no click lies before all event times; the last batch has one after all of them, so that the
    watermark of the start that follows ends the stream.
    """
    spark = rows.sparkSession
    ticks = spark.range(0, n, 1, 1).select(F.col("id").alias("batch"), F.when(F.col("id") == n - 1, END_US).otherwise(0).alias("us"))
    ticks = ticks.select("batch", F.lit(None).cast("long").alias("click_id"), F.lit(None).cast("string").alias("kind"), (F.col("us") - SHIFT_US).alias("event_us"), F.lit(None).cast("long").alias("hour"), F.lit(None).cast("long").alias("cents"))
    rows.unionByName(ticks).write.partitionBy("batch").parquet(folder)
    written = spark.read.parquet(folder).where("click_id is not null")
    latest = {r["batch"]: r["w"] for r in written.groupBy("batch").agg(F.max("event_us").alias("w")).collect()}  # n rows at most
    out: list[int | None] = [None]
    for b in range(n):
        known = [w for w in (out[-1], latest.get(b)) if w is not None]
        out.append(max(known, default=None))
    return out[:n]


def combined(watermark_us: int | None, grace: int, open_hours: int) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """A task's rows added up by kind and hour; rows of closed panes one by one."""
    # Hours of panes that are closed: end + open_hours <= W.
    closed = None if watermark_us is None else watermark_us // HOUR_US - open_hours - 1
    names = ("kind", "day", "part", "hour", "click_id", "n_rows", "cents")
    kinds = (pa.string(), *[pa.int64()] * 6)

    def batch_of(columns: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))

    def panes(totals: dict) -> pa.RecordBatch:
        kind, hour = zip(*totals, strict=True)
        n, cents = zip(*totals.values(), strict=True)
        k = len(kind)
        return batch_of((kind, [h // 24 for h in hour], [-1] * k, hour, [-1] * k, n, cents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        totals: dict[tuple[str, int], tuple[int, int]] = {}
        for batch in batches:
            batch = batch.filter(batch.column("click_id").is_valid())
            hours = batch.column("hour").to_numpy(zero_copy_only=False)
            is_late = hours <= closed if closed is not None else np.zeros(len(hours), bool)
            if is_late.any():
                some = batch.filter(pa.array(is_late))
                ids, at = some.column("click_id").to_numpy(), hours[is_late]
                yield batch_of((some.column("kind"), at // 24, ids % SPREAD, at, ids, np.ones(len(ids), np.int64), some.column("cents")))
            some = pa.Table.from_batches([batch.filter(pa.array(~is_late))]).group_by(["kind", "hour"]).aggregate([("cents", "count"), ("cents", "sum")])
            for kind, hour, n, cents in zip(*(some.column(c).to_pylist() for c in ("kind", "hour", "cents_count", "cents_sum")), strict=True):
                have = totals.get((kind, hour), (0, 0))
                totals[kind, hour] = have[0] + n, have[1] + cents
            if len(totals) > PANES:
                yield panes(totals)
                totals = {}
        if totals:
            yield panes(totals)

    return run


class PaneShard(StatefulProcessor):
    """The panes of a kind and day; grace and open_hours count from an hour's end."""

    def __init__(self, batch: int, grace: int, open_hours: int, emitted: str = "emit"):
        self.batch, self.emitted = batch, emitted
        self.grace, self.open_hours = grace, open_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # sent: whether the pane was written, and with which totals.
        self.totals = handle.getMapState("totals", "hour long", "n_rows long, cents long, sent boolean, sent_rows long, sent_cents long")
        self.dirty = handle.getMapState("dirty", "hour long", "rows long")
        self.timer = handle.getValueState("timer", "at long")

    def deadline(self, hour: int, after: int) -> int:
        """Milliseconds of the watermark at which so many hours have passed since the hour's end."""
        return (hour + 1 + after) * 3_600_000 + SHIFT_US // 1000

    def row(self, record: str, kind: str, hour: int, click_id: int, n: int, cents: int) -> Row:
        return Row(batch=self.batch, record=record, kind=kind, hour=hour, click_id=click_id, n_rows=n, cents=cents)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, added = timerValues.getCurrentWatermarkInMs(), {}
        for r in rows:
            if now >= self.deadline(r.hour, self.open_hours):
                yield self.row("late", r.kind, r.hour, r.click_id, r.n_rows, r.cents)
            else:
                n, cents = added.get(r.hour, (0, 0))
                added[r.hour] = n + r.n_rows, cents + r.cents
        for hour, (n, cents) in added.items():
            have = self.totals.getValue((hour,)) or (0, 0, False, 0, 0)
            self.totals.updateValue((hour,), (have[0] + n, have[1] + cents, *have[2:]))
            self.dirty.updateValue((hour,), (n,))
        if added:
            self.reschedule(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, kind = timerValues.getCurrentWatermarkInMs(), key[0]
        changed = {hour for (hour,) in list(self.dirty.keys())}
        for (hour,), (n, cents, sent, sent_rows, sent_cents) in sorted(self.totals.iterator()):
            due = now >= self.deadline(hour, self.grace)
            if sent and hour in changed:
                yield self.row("retract", kind, hour, -1, sent_rows, sent_cents)
                yield self.row("replace", kind, hour, -1, n, cents)
            elif due and not sent:
                yield self.row(self.emitted, kind, hour, -1, n, cents)
            if now >= self.deadline(hour, self.open_hours):
                self.totals.removeKey((hour,))
            elif due:
                self.totals.updateValue((hour,), (n, cents, True, n, cents))
        self.dirty.clear()
        self.reschedule(now)

    def reschedule(self, now: int) -> None:
        """One timer, at the earliest deadline; without panes none."""
        changed = {hour for (hour,) in list(self.dirty.keys())}
        at = min((now if v[2] and hour in changed else self.deadline(hour, self.open_hours if v[2] else self.grace) for (hour,), v in self.totals.iterator()), default=None)
        set_to = self.timer.get()
        if set_to is not None and set_to[0] != at:
            self.handle.deleteTimer(set_to[0])
        if at is None:
            self.timer.clear()
        elif set_to is None or set_to[0] != at:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings in force inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: State in RocksDB, of which a batch writes the changes. Every start is one batch, so there are no batches without
#: rows, and a task closes its store when it commits: the next start loads it anew, and it takes disk until then.
STREAM = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder of the shared file system; done already counts as done."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.exists(b) and not fs.rename(a, b):
        raise OSError(f"{source} can't become {target}")


def step(spark: SparkSession, source: str, out: str, checkpoint: str, batch: int, watermark_us: int | None, grace: int, open_hours: int, ends: bool = False) -> None:
    """One start of the stream: what is new in the folder, as one micro-batch on what the checkpoint keeps."""
    feed = spark.readStream.schema(FEED).parquet(source)
    timed = feed.withColumn("event_time", F.timestamp_micros(F.col("event_us") + SHIFT_US)).withWatermark("event_time", "0 seconds")
    partial = timed.select("click_id", "kind", "hour", "cents", "event_time").mapInArrow(combined(watermark_us, grace, open_hours), PARTIAL)
    shard = PaneShard(batch, grace, open_hours, "final" if ends else "emit")
    records = partial.groupBy("kind", "day", "part").transformWithState(shard, RECORDS, "Append", "EventTime")
    query = records.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def revised_panes(clicks: DataFrame, n: int = 10, grace: int = 12, open_hours: int = 48) -> DataFrame:
    """(batch, record, kind, hour, click_id, n_rows, cents) of a stream over clicks in n batches.

    record is emit, retract, replace, late or final, as the module says; click_id is -1 unless a row is late.
    hour counts from 1970, in the batches' event time, and may be negative. Nulls and repeated rows as in
    `batched`; equal event times make no difference, for only hours and their largest count. An empty table
    gives no records. The stream starts anew for each batch on one checkpoint, in a new folder of the shared
    one; a start that fails can be made again, its files and its state are written once. Further columns are
    not read.
    """
    spark = clicks.sparkSession
    ready(spark)
    folder = scratch(spark, "panes")
    cut, feed, out, checkpoint = (f"{folder}/{name}" for name in ("cut", "feed", "records", "checkpoint"))
    watermarks = write_batches(batched(clicks, n), n, cut)
    # One start more, with a row of no click: its watermark is beyond every deadline.
    spark.createDataFrame([(None, None, END_US - SHIFT_US, None, None)], FEED).coalesce(1).write.parquet(f"{cut}/batch={n}")
    with settings(spark, STREAM):
        for b in range(n + 1):
            move(spark, f"{cut}/batch={b}", f"{feed}/batch={b}")
            step(spark, feed, out, checkpoint, min(b, n - 1), watermarks[b] if b < n else None, grace, open_hours, ends=b == n)
    return spark.read.schema(RECORDS).parquet(out)
