"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch; texts may be long, so batches stay small.
BATCH_ROWS = 256
#: Characters of text that one step of a vectorised operator takes at once.
STEP_CHARS = 1 << 18
#: Rows and bytes up to which a measured side of a join is broadcast; beyond them the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
#: The same for joins of ids, which cost little to shuffle. What is broadcast passes through the driver, which holds
#: it several times over: as it comes, as a hashed table that grows by doubling, as the blocks that are sent.
IDS_ROWS = 250_000
IDS_BYTES = 8 << 20

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ready(spark: SparkSession) -> None:
    """Small Arrow batches for the session (texts may be long), and a folder for intermediate tables.

    A local session that names no spark.checkpoint.dir gets a temporary folder. On a cluster there is no
    folder that all executors are known to share unless it is named, so that raises an error.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if not shared_dir(spark):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def shared_dir(spark: SparkSession) -> str | None:
    """The checkpoint folder in force: the cluster's setting, or one set on the context."""
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        spark.sparkContext.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """The frame, computed once, written to the shared checkpoint folder and read again.

    That cuts the lineage like checkpoint(), but the plan starts afresh with the sizes of the files, so joins
    in a loop are planned by what there is. The files go when the application ends.
    """
    spark = df.sparkSession
    ready(spark)
    path = scratch(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Removes what is at the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):  # the context may have ended
            forget(spark, path)


def small(df: DataFrame, row_bytes: str = "0", rows: int | None = None, most_bytes: int | None = None) -> bool:
    """Whether a kept frame is within the broadcast bounds; row_bytes is SQL for a row's variable bytes."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.expr(row_bytes).cast("long") + 32)).first()
    return (n or 0) <= min(rows or BROADCAST_ROWS, BROADCAST_ROWS) and (size or 0) <= min(most_bytes or BROADCAST_BYTES, BROADCAST_BYTES)


def measured(df: DataFrame, row_bytes: str = "0", rows: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """The kept frame with a broadcast hint if its measured size allows one, else with a hint to merge.

    Without the latter Spark may broadcast it after all, by the size of its compressed files.
    """
    return F.broadcast(df) if small(df, row_bytes, rows, most_bytes) else df.hint("merge")


def small_ids(df: DataFrame, row_bytes: str = "0") -> bool:
    """Whether a kept frame is within the bounds for joins of ids."""
    return small(df, row_bytes, IDS_ROWS, IDS_BYTES)


def measured_ids(df: DataFrame, row_bytes: str = "0") -> DataFrame:
    """measured() with the bounds for joins of ids, so that no more passes through the driver as the rows grow."""
    return measured(df, row_bytes, IDS_ROWS, IDS_BYTES)


def map_rows(
    df: DataFrame,
    step: Callable[[dict[str, list]], dict[str, object]],
    schema: T.StructType,
    weigh: str | None = "text",
    step_chars: int = STEP_CHARS,
) -> DataFrame:
    """Apply step to column lists of a few hundred rows at a time, cut at step_chars of the column weigh.

    step gets and returns a dict of columns; every batch is independent, so a lost task is simply run again.
    """

    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            columns = batch.to_pydict()
            for a, b in cuts(columns[weigh] if weigh else None, batch.num_rows, step_chars):
                out = step({k: v[a:b] for k, v in columns.items()})
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _column(values: object, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def cuts(texts: list | None, n: int, step_chars: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    start = weight = 0
    for i in range(n):
        weight += len(texts[i] or "") if texts is not None else 0
        if weight >= step_chars:
            yield start, i + 1
            start, weight = i + 1, 0
    if start < n:
        yield start, n


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Words longer than this (bytes) get their hash from a library; shorter ones from a polynomial.
_SHORT = 256
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 18), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of bytes that aren't ASCII white space), and the number in each text."""
    joined = b" " + b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    white = _WHITE[data]
    first = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    last = np.flatnonzero(~white[:-1] & white[1:]) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_BASE, len(data)), out=total[1:])
    length = (last - first).astype(np.uint64)
    found = mix((total[last] - total[first]) * powers(inverse(_BASE), len(data) + 1)[first] + length)
    for i in np.flatnonzero(length > _SHORT).tolist():
        from xxhash import xxh64_intdigest

        found[i] = xxh64_intdigest(joined[first[i] : last[i]])
    edges = np.cumsum([1] + [len(t) + 1 for t in texts])
    return found, np.diff(np.searchsorted(first, edges))


def columns_of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A function of 64 bits of an id for a fraction of its rows that is the same on every run.
def sampled(column: str, fraction: float, salt: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col(column).cast("string")), F.lit(1 << 40)) < F.lit(int(fraction * (1 << 40)))
