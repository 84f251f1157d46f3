"""The snapshot data source: round trips, commits, conditions on the day, bad lines, streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from narrata.sources import snapshot_source as source

KINDS = "id long, name string, at timestamp, day date, price decimal(10,2), tags array<string>, dt string, bad_line string"


@pytest.fixture
def rows(spark):
    source.register(spark)
    utc = dt.timezone.utc
    data = [(i, f"né {i}" if i % 4 else None, dt.datetime(2024, 1, 1 + i % 3, 5, tzinfo=utc), dt.date(2024, 1, 1), None, ["a", None] if i % 2 else [], f"2024-01-0{1 + i % 3}", None) for i in range(50)]
    return spark.createDataFrame(data, KINDS)


def read(spark, path, kinds=KINDS):
    return spark.read.format("narrata_snapshot").schema(kinds).load(path)


def test_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    rows.repartition(3).write.format("narrata_snapshot").option("per_file", 4).mode("append").save(path)
    assert sorted(read(spark, path).collect()) == sorted(rows.collect())
    assert all(sum(1 for _ in open(p)) <= 4 for p in (tmp_path / "s").rglob("*.ndjson"))
    rows.limit(7).write.format("narrata_snapshot").mode("append").save(path)
    assert read(spark, path).count() == 57
    rows.limit(5).write.format("narrata_snapshot").mode("overwrite").save(path)
    assert read(spark, path).count() == 5
    rows.limit(0).write.format("narrata_snapshot").mode("overwrite").save(path)
    assert read(spark, path).count() == 0 and read(spark, str(tmp_path / "none")).count() == 0


def test_a_write_that_breaks_off_leaves_nothing_to_see(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    rows.limit(3).write.format("narrata_snapshot").mode("append").save(path)
    broken = rows.repartition(4).withColumn("id", F.when(F.col("id") == 41, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("narrata_snapshot").option("per_file", 1).mode("append").save(path)
    assert read(spark, path).count() == 3 and source.count_commits(path) == 1


def test_days_choose_files(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    rows.write.format("narrata_snapshot").mode("append").save(path)
    for condition, days in (("dt = '2024-01-02'", {2}), ("dt > '2024-01-01' AND dt < '2024-01-03'", {2}), ("dt >= '2024-01-02'", {2, 3}), ("dt <= '2024-01-01'", {1}), ("dt IN ('2024-01-01', '2024-01-03')", {1, 3})):
        assert {r["id"] for r in read(spark, path).where(condition).collect()} == {i for i in range(50) if 1 + i % 3 in days}
    reader = source.Reader(path, rows.schema)
    other = source.GreaterThan(("id",), 3)
    assert list(reader.pushFilters([source.EqualTo(("dt",), "2024-01-02"), other])) == [other]
    assert {p.day for p in reader.partitions()} == {"2024-01-02"}
    for p in (tmp_path / "s" / "dt=2024-01-01").iterdir():  # files of other days aren't opened
        p.unlink()
    assert read(spark, path).where("dt = '2024-01-02'").count() == 17


def test_bad_lines_are_counted(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    rows.coalesce(1).write.format("narrata_snapshot").mode("append").save(path)
    file = next((tmp_path / "s" / "dt=2024-01-02").iterdir())
    bad = [b"{broken", b"[1]", b'{"id": "no number"}', b'{"id": 1, "at": "some day"}', b"\xff\xfe", b'{"id": 1, "tags": 5}']
    file.write_bytes(file.read_bytes() + b"\n".join([b"", *bad, b"  ", b'{"id": 99, "more": 1}']))
    found = read(spark, path)
    lines = [(r["dt"], r["bad_line"]) for r in found.where("bad_line IS NOT NULL").collect()]
    assert sorted(lines) == sorted(("2024-01-02", b.decode(errors="replace")) for b in bad)
    assert found.where("bad_line IS NULL").count() == 51 and found.where("id = 99 AND dt = '2024-01-02' AND name IS NULL").count() == 1


def test_stream_goes_on_at_its_checkpoint(spark, rows, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("s", "out", "c"))

    def run():
        stream = spark.readStream.format("narrata_snapshot").schema(KINDS).load(path)
        stream.select("id", "dt").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    rows.where("id < 10").write.format("narrata_snapshot").mode("append").save(path)
    assert run() == list(range(10))
    rows.where("id >= 10 AND id < 20").write.format("narrata_snapshot").mode("append").save(path)
    rows.where("id >= 20 AND id < 30").write.format("narrata_snapshot").mode("append").save(path)
    assert run() == list(range(30)) and run() == list(range(30))


def test_log_of_commits(spark, rows, tmp_path):
    path = str(tmp_path / "s")
    rows.write.format("narrata_snapshot").mode("append").save(path)
    entry = json.loads((tmp_path / "s" / source.LOG / f"{0:012d}.json").read_text())
    assert entry["overwrite"] is False and sum(f["rows"] for f in entry["files"]) == 50
