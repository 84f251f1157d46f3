"""Snapshots as a data source of their own: `spark.read.format("narrata_snapshot")`, its writer and its stream.

A snapshot is a folder of line-delimited JSON, in folders by day, and a log of commits. A commit is one file
that names the data files of one write; what no commit names isn't there, so a write that breaks off leaves
nothing to see, and one commit more is what a stream finds new. Lines that aren't records come as rows with
the line in the column bad_line, the file's day, and all else null.

The folder must be open to the driver and all workers: a shared file system, or an address that pyarrow reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

BAD, DAY, LOG = "bad_line", "dt", "_log"
#: Lines that one batch is made of.
LINES = 5_000


def store(path: str):
    """The file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def commits(path: str, since: int = 0, until: int | None = None) -> list[dict]:
    """The files of commits since to until, {"path", "day", "rows"}, less those that a later overwrite took away."""
    from pyarrow import fs

    system, root = store(path)
    known = sorted(f.path for f in system.get_file_info(fs.FileSelector(f"{root}/{LOG}", allow_not_found=True)) if f.path.endswith(".json"))
    files: list[dict] = []
    for at in known[since:until]:
        with system.open_input_stream(at) as f:
            entry = json.loads(f.read())
        files = ([] if entry["overwrite"] else files) + entry["files"]
    return files


def count_commits(path: str) -> int:
    from pyarrow import fs

    system, root = store(path)
    return sum(f.path.endswith(".json") for f in system.get_file_info(fs.FileSelector(f"{root}/{LOG}", allow_not_found=True)))


@dataclass
class File(InputPartition):
    path: str
    day: str

    def __init__(self, path: str, day: str):
        super().__init__(path)
        self.path, self.day = path, day


def arrow_of(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def column(values: list, kind: pa.DataType) -> pa.Array:
    """Values of JSON as a column; times and decimals are text there."""
    if pa.types.is_temporal(kind) or pa.types.is_decimal(kind):
        return pa.array(values, pa.string()).cast(kind)
    return pa.array(values, kind)


def batch_of(lines: list[bytes], day: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The records of some lines; a line that isn't a JSON object of the schema's types is a bad one."""
    records: list[dict] = []
    for line in lines:
        try:
            x = json.loads(line)
            if not isinstance(x, dict):
                raise ValueError
        except ValueError:
            x = {BAD: line.decode(errors="replace")}
        records.append(x | {DAY: day})
    try:
        yield pa.RecordBatch.from_arrays([column([x.get(f.name) for x in records], f.type) for f in schema], schema=schema)
    except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError):
        if len(lines) == 1:
            yield pa.RecordBatch.from_arrays([column([{BAD: lines[0].decode(errors="replace"), DAY: day}.get(f.name)], f.type) for f in schema], schema=schema)
        else:
            half = len(lines) // 2
            yield from batch_of(lines[:half], day, schema)
            yield from batch_of(lines[half:], day, schema)


def read_file(part: File | None, path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if part is None:  # Spark asks for that where there is no file at all
        return
    system, root = store(path)
    with system.open_input_stream(f"{root}/{part.path}") as f:
        left, lines = b"", []
        while block := f.read(1 << 20):
            *whole, left = (left + block).split(b"\n")
            lines += [x for x in whole if x.strip()]
            while len(lines) >= LINES:
                yield from batch_of(lines[:LINES], part.day, schema)
                lines = lines[LINES:]
        lines += [left] if left.strip() else []
        if lines:
            yield from batch_of(lines, part.day, schema)


class Reader(DataSourceReader):
    """One partition a file; conditions on the day choose the files and needn't be looked at again."""

    TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in self.TESTS and f.attribute == (DAY,):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[File]:
        found = [File(f["path"], f["day"]) for f in commits(self.path)]
        return [f for f in found if all(self.TESTS[type(t)](f.day, t.value) for t in self.filters)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return read_file(partition, self.path, arrow_of(self.schema))


class StreamReader(DataSourceStreamReader):
    """Offsets are numbers of commits; an overwrite among new commits counts as what it wrote."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": count_commits(self.path)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(f["path"], f["day"]) for f in commits(self.path, start["commit"], end["commit"])]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return read_file(partition, self.path, arrow_of(self.schema))


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


class Writer(DataSourceArrowWriter):
    """Every task writes files of its own, one for each day and per_file rows; the driver's commit makes them count."""

    def __init__(self, path: str, overwrite: bool, per_file: int):
        self.path, self.overwrite, self.per_file = path, overwrite, per_file

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = store(self.path)
        files: list[dict] = []
        held: dict[str, list[bytes]] = {}

        def put(day: str) -> None:
            lines = held.pop(day)
            name = f"{DAY}={day}/{uuid.uuid4().hex}.ndjson"
            system.create_dir(f"{root}/{DAY}={day}", recursive=True)
            with system.open_output_stream(f"{root}/{name}") as f:
                f.write(b"\n".join(lines) + b"\n")
            files.append({"path": name, "day": day, "rows": len(lines)})

        for batch in iterator:
            for row in batch.to_pylist():
                day = str(row.pop(DAY, None) or "none")
                lines = held.setdefault(day, [])
                lines.append(json.dumps({k: v for k, v in row.items() if k != BAD}, default=str, ensure_ascii=False).encode())
                if len(lines) >= self.per_file:
                    put(day)
            while len(held) > 1 and sum(map(len, held.values())) >= self.per_file:
                put(max(held, key=lambda d: len(held[d])))
        for day in list(held):
            put(day)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        system.create_dir(f"{root}/{LOG}", recursive=True)
        body = json.dumps({"overwrite": self.overwrite, "files": [f for m in messages if m for f in m.files]}).encode()
        whole = f"{root}/{LOG}/{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(whole) as f:
            f.write(body)
        system.move(whole, f"{root}/{LOG}/{count_commits(self.path):012d}.json")  # one writer at a time

    def abort(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        for f in (f for m in messages if m for f in m.files):
            system.delete_file(f"{root}/{f['path']}")


class SnapshotSource(DataSource):
    """Options: path; per_file, the most rows of a file (1000)."""

    @classmethod
    def name(cls) -> str:
        return "narrata_snapshot"

    def schema(self) -> str:
        return f"exchange_id string, natural_key string, content_sha256 string, observed_at_utc timestamp, response string, {DAY} string, {BAD} string"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite, int(self.options.get("per_file", 1000)))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with conditions on the day handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)
