"""Streams run to the end of their input and compared with the batch answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from narrata.sources import records
from narrata.streaming import events, runloop


def run(spark, stream, name, mode, **options):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, rows, schema, folder):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(df.schema).parquet(str(folder))


def test_sessions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t), (1, t + dt.timedelta(minutes=10)), (1, t + dt.timedelta(hours=2)), (2, t)]
    found = run(spark, events.sessions(source(spark, rows, "user_id long, ts timestamp", tmp_path / "s")), "sessions_t", "complete")
    assert sorted((r["user_id"], r["n"]) for r in found.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_repeats_are_ignored(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t), ("a", t + dt.timedelta(minutes=1)), ("b", t)]
    found = run(spark, events.first_seen(source(spark, rows, "k string, ts timestamp", tmp_path / "s"), "k"), "seen_t", "append")
    assert sorted(r["k"] for r in found.collect()) == ["a", "b"]


def test_job_states(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "FAILED", t), (1, "SUCCEEDED", t + dt.timedelta(1)), (2, "FAILED", t), (2, "FAILED", t), (2, "FAILED", t), (2, "SUCCEEDED", t + dt.timedelta(1)), (3, "FAILED", t)]
    found = run(spark, events.job_states(source(spark, rows, "job_id long, outcome string, ts timestamp", tmp_path / "s")), "jobs_t", "update")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, "SUCCEEDED"), (2, 3, "DEADLETTER"), (3, 1, "NEW")]


def test_snapshot_round_trip(spark, tmp_path):
    t = dt.datetime(2024, 3, 4, 5)
    rows = spark.createDataFrame([(f"e{i}", "http", "s", "e", f"k{i}", t, "h", "{}", "[]", 1, ["x"]) for i in range(5)], records.EXCHANGE)
    path = str(tmp_path / "snap")
    records.write_snapshot(rows, path, 2)
    (tmp_path / "snap" / "bad.json").write_text("not json\n")
    good, bad = records.read_snapshot(spark, path)
    assert sorted(r["exchange_id"] for r in good.select("exchange_id").collect()) == [f"e{i}" for i in range(5)]
    assert bad.count() == 1
    assert (tmp_path / "snap" / "yyyy=2024" / "dt=2024-03-04").exists()


def test_lake_and_seeds(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "n", None, "x")], "source_system string, source_name string, resource_type string, payload string")
    records.write_lake(rows, str(tmp_path / "lake"))
    assert (tmp_path / "lake" / "source_system_dir=a_b" / "source_name_dir=n" / "resource_type_dir=none").exists()
    (tmp_path / "seed.json").write_text('{"seedVersion": "1", "target": {"schema": "dbo", "table": "T"},\n "rows": [{"k": 1}, {"k": 2}]}')
    got = records.read_seeds(spark, str(tmp_path / "seed.json"), spark.createDataFrame([], "k int").schema)
    assert [(r["target_table"], r["k"]) for r in got.orderBy("k").collect()] == [("dbo.T", 1), ("dbo.T", 2)]
    assert got.where(F.col("seedVersion") == "1").count() == 2


def loop_of(rows, max_attempts=3, wait=60_000, remember=86_400_000):
    """The commands of items, one item after the other, until all is due."""
    out = []
    for item in {r[0] for r in rows if r[0] is not None}:
        state = None

        def passed(now):
            nonlocal state
            if state and state[0] == "waiting" and state[2] <= now:
                out.append((item, "fetch", state[1] + 1, state[2]))
                state = ("running", state[1] + 1, 0)
            elif state and state[0] == "ended" and state[2] <= now:
                state = None

        for _, at, _, status in sorted(r for r in rows if r[0] == item and r[1] is not None):
            passed(at)
            if status is None:
                if state is None:
                    state = ("running", 1, 0)
                    out.append((item, "fetch", 1, at))
            elif state is None or state[0] != "running":
                out.append((item, "stray", 0, at))
            elif status == 200 or state[1] >= max_attempts:
                out.append((item, "completed" if status == 200 else "failed", state[1], at))
                state = ("ended", state[1], at + remember)
            else:
                state = ("waiting", state[1], at + wait * 2 ** (state[1] - 1))
        passed(float("inf"))
    return sorted(out)


def loop_rows(n=240):
    import random

    r = random.Random(3)
    zero, rows = 1_700_000_000_000, []
    for i in range(n):
        at = zero + i * 20_000 + r.choice([0, 0, 5])
        rows.append((r.choice(["a", "a", "b", "c", "d", None]), at, i, r.choice([None, None, 200, 500, 503, 503])))
    return rows


def as_rows(spark, rows, batch):
    df = spark.createDataFrame([(*x, batch(k)) for k, x in enumerate(rows)], "item string, ms long, seq long, status_code int, batch int")
    return df.withColumn("at", F.timestamp_millis("ms"))


@pytest.mark.parametrize("n", [1, 3])
def test_run_loop_is_the_same_however_it_is_cut(spark, n):
    rows = loop_rows()
    found = runloop.replay(as_rows(spark, rows, lambda k: k * n // len(rows)), n, max_attempts=2, wait_ms=30_000, remember_ms=400_000)
    expected = loop_of(rows, 2, 30_000, 400_000)
    assert sorted(map(tuple, found.collect())) == expected
    assert {x[1] for x in expected} == {"fetch", "completed", "failed", "stray"} and any(x[1:3] == ("fetch", 2) for x in expected)


def test_run_loop_after_a_broken_start(spark, monkeypatch):
    """A restart from the checkpoint loses and doubles nothing."""
    rows, made, broken = loop_rows(120), runloop.start, []

    def breaks(*args, **limits):
        if len(broken) == 1:
            with pytest.raises(Exception):  # the first failed attempt breaks the task
                made(*args, **limits | {"wait_ms": None}).awaitTermination()
        broken.append(1)
        return made(*args, **limits)

    monkeypatch.setattr(runloop, "start", breaks)
    found = runloop.replay(as_rows(spark, rows, lambda k: k * 2 // len(rows)), 2, remember_ms=60_000)
    assert sorted(map(tuple, found.collect())) == loop_of(rows, remember=60_000)


def test_run_loop_of_the_clicks(spark, sf):
    """The registered query against the loop, item by item."""
    from narrata.queries import queries

    zero = dt.datetime(1970, 1, 1)
    rows = {}
    for r in spark.read.parquet(f"{sf}/clicks.parquet").collect():
        if None not in (r["click_id"], r["client_id"], r["arrived_at"]):
            status = 503 if r["kind"] == "error" else 200 if r["kind"] in ("click", "purchase") else None
            rows[r["click_id"]] = (f"{r['client_id']}:{r['arrived_at']:%Y-%m-%d %H}", (r["arrived_at"] - zero) // dt.timedelta(milliseconds=1), r["click_id"], status)
    assert sorted(map(tuple, queries()["fetch_loop"](spark, sf).collect())) == loop_of(list(rows.values()))
