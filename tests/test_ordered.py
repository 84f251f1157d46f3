"""Carried values, as-of and interval joins, histories, schedules and gram matching, against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from narrata.functions.times import HOUR, micros, slot, stamp
from narrata.operators import grams, history, intervals, ordered
from narrata.plans import shop  # noqa: F401
from narrata.queries import queries

ZERO = dt.datetime(1969, 12, 30)


def at(hours):
    return None if hours is None else ZERO + dt.timedelta(hours=hours)


def test_times_without_a_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [(dt.datetime(2024, 3, 10, 2, 30, 0, 123456),), (dt.datetime(1969, 12, 31, 23, 0),), (None,)]
        df = spark.createDataFrame(rows, "t timestamp_ntz").select("t", micros("t").alias("us"))
        found = df.select("t", "us", slot(F.col("us"), HOUR).alias("s"), stamp(F.col("us")).alias("again")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    zero = dt.datetime(1970, 1, 1)
    for r in found:
        us = None if r["t"] is None else (r["t"] - zero) // dt.timedelta(microseconds=1)
        assert (r["us"], r["s"], r["again"]) == (us, None if us is None else us // HOUR, r["t"])


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_before(spark, reverse, inclusive):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), i, r.choice([None, r.randrange(9)])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i long, v long").withColumn("block", F.floor(F.col("i") / 7))
    values = {"last": ("last", F.col("v")), "most": ("max", F.col("v")), "total": ("sum", F.col("v"))}
    for row in ordered.before(df, ["k"], "block", ["i"], values, inclusive, reverse).collect():
        seen = [v for k, i, v in rows if k == row["k"] and v is not None and ((i > row["i"]) if reverse else (i < row["i"]))]
        if inclusive and row["v"] is not None:
            seen = [row["v"], *seen] if reverse else [*seen, row["v"]]
        assert (row["last"], row["most"], row["total"]) == ((seen[0] if reverse else seen[-1]) if seen else None, max(seen, default=None), sum(seen))
    with pytest.raises(ValueError):
        ordered.before(df, ["k"], "block", ["i"], {"x": ("first", F.col("v"))})


def test_as_of(spark):
    r = random.Random(2)
    left = [(r.choice(["hot", "hot", "b", None]), at(r.choice([None, *range(-40, 200)])), i % 50, "clash") for i in range(300)]
    right = [(r.choice(["hot", "b", "only", None]), at(r.choice([None, *range(-20, 190)])), i, f"r{i}") for i in range(80)]
    a = spark.createDataFrame(left, "k string, t timestamp_ntz, n int, _slot string")
    b = spark.createDataFrame(right, "k string, since timestamp_ntz, tie int, value string")
    found = ordered.as_of(a, b, ["k"], "t", "since", ["value"], ["tie"], width=24 * HOUR)

    def match(k, t):
        best = max(((x[1], x[2], x[3]) for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t), default=None)
        return best and best[2]

    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((*x, match(x[0], x[1])) for x in left), key=repr)
    assert ordered.as_of(a.limit(0), b, ["k"], "t", "since", ["value"]).count() == 0
    assert ordered.as_of(a, b.limit(0), ["k"], "t", "since", ["value"]).where("value IS NULL").count() == 300
    with pytest.raises(ValueError):
        ordered.as_of(a, b.withColumn("n", F.lit(1)), ["k"], "t", "since", ["n"])


def test_as_of_has_no_window_over_a_whole_key_of_rows(spark):
    """A hot key's rows are dealt out by key and slot."""
    rows = spark.range(5000).select(F.expr("if(id < 4999, 'hot', 'cold')").alias("k"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(id as int))").alias("t"), "id")
    laid = ordered.before(rows.withColumn("s", slot(micros("t"), HOUR)), ["k"], "s", ["id"], {"last": ("last", F.col("id"))})
    plan = laid._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and ", s#" in plan
    assert laid.where("last <> id - 1").count() == 0 and laid.where("last IS NULL").count() == 2


def test_spaced(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "cold", None]), r.choice([None, r.randrange(2000) - 500]), i) for i in range(400)]
    found = ordered.spaced(spark.createDataFrame(rows, "host string, at long, i int"), ["host"], "at", ["i"], 7, width=100).collect()
    expected = []
    for host in ("hot", "cold"):
        free = None
        for t, i in sorted((t, i) for h, t, i in rows if h == host and t is not None):
            free = t if free is None else max(t, free + 7)
            expected.append((host, t, i, free))
    assert sorted(map(tuple, found)) == sorted(expected)
    with pytest.raises(ValueError):
        ordered.spaced(spark.range(1), ["id"], "id", [], -1)


def some_changes(n=200, seed=4):
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), at(r.choice([None, *range(60)])), r.choice([None, 1, 2, 3]), i, r.choice("xy"), r.choice([None, 1.5]), r.choice("UUUD")) for i in range(n)]
    return rows + rows[:20]


SCHEMA = "k int, t timestamp_ntz, seq int, id int, name string, value double, op string"


def chains_of(rows):
    """Rows (k, t, order, state) to versions (k, from, to, number, state)."""
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        last = {}
        for _, t, order, state in sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: r[2]):
            last[t] = state
        chain = []
        for t in sorted(last):
            if not chain or chain[-1][1] != last[t]:
                chain.append((t, last[t]))
        for i, (t, state) in enumerate(chain):
            out[k, t] = (chain[i + 1][0] if i + 1 < len(chain) else None, i + 1, state)
    return out


def order_of(r):
    low = lambda x: (x is not None, x or 0)
    return (low(r[2]), low(r[3]))


def as_found(df):
    return {(r["k"], r["ValidFromUtc"]): (r["ValidToUtc"], r["VersionNum"], (r["name"], r["value"], not r["IsActive"])) for r in df.collect()}


def test_versions(spark):
    rows = some_changes()
    found = history.versions(spark.createDataFrame(rows, SCHEMA), ["k"], "t", ["seq", "id"], ["name", "value"], F.col("op") == "D", width=10 * HOUR)
    assert as_found(found) == chains_of([(r[0], r[1], order_of(r), (r[4], r[5], r[6] == "D")) for r in rows])
    assert history.broken_chains(found, ["k"]).count() == 0
    assert history.broken_chains(found.where("VersionNum <> 2"), ["k"]).count() > 0
    assert history.versions(spark.createDataFrame([], SCHEMA), ["k"], "t", ["seq"], ["name"]).count() == 0


def test_merge_of_late_changes(spark):
    first, late = some_changes(150, 5), [*some_changes(60, 6), (9, at(5), 1, 1, "new", None, "U")]
    gone = F.col("op") == "D"
    old = history.versions(spark.createDataFrame(first, SCHEMA), ["k"], "t", ["seq", "id"], ["name", "value"], gone, 10 * HOUR)
    merged = history.merge(old, spark.createDataFrame(late, SCHEMA), ["k"], "t", ["seq", "id"], ["name", "value"], gone, 10 * HOUR)
    was = chains_of([(r[0], r[1], order_of(r), (r[4], r[5], r[6] == "D")) for r in first])
    expected = chains_of([(k, t, (0,), v[2]) for (k, t), v in was.items()] + [(r[0], r[1], (1, *order_of(r)), (r[4], r[5], r[6] == "D")) for r in late])
    assert as_found(merged) == expected and history.broken_chains(merged, ["k"]).count() == 0
    for r in merged.collect():
        before, now = was.get((r["k"], r["ValidFromUtc"])), expected[r["k"], r["ValidFromUtc"]]
        assert r["action"] == ("opened" if before is None or before[2] != now[2] else "left" if before[0] == now[0] else "closed")
    again = history.merge(merged.drop("action"), spark.createDataFrame(late, SCHEMA), ["k"], "t", ["seq", "id"], ["name", "value"], gone, 10 * HOUR)
    assert as_found(again) == expected and again.where("action <> 'left'").count() == 0


@pytest.mark.parametrize("dealt", [3, 20_000])
def test_overlaps(spark, monkeypatch, dealt):
    monkeypatch.setattr(intervals, "DEALT", dealt)
    r = random.Random(7)
    some = lambda n: [(r.choice(["a", "a", "b", None]), s := r.choice([None, *range(-30, 60)]), None if s is None else r.choice([None, s, s - 1, s + 1, s + 5, s + 90]), i) for i in range(n)]
    left, right = some(120), some(100)
    right += right[:3]
    schema = "k string, s long, e long, i int"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    inf = float("inf")
    usable = lambda x: x[0] is not None and x[1] is not None and (x[2] is None or x[2] > x[1])
    want = sorted((x[3], y[3]) for x in left for y in right if usable(x) and usable(y) and x[0] == y[0] and max(x[1], y[1]) < min(inf if x[2] is None else x[2], inf if y[2] is None else y[2]))
    for width in (1, 8, 1000):
        found = intervals.overlaps(a, b, ["k"], "s", "e", width)
        assert sorted((q["i"], q["i_right"]) for q in found.collect()) == want
    assert intervals.overlaps(a, b.limit(0), ["k"], "s", "e", 8).count() == 0
    plan = intervals.overlaps(a, b, ["k"], "s", "e", 8)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("dealt", [2, 20_000])
def test_names_in_texts(spark, monkeypatch, dealt):
    monkeypatch.setattr(grams, "DEALT", dealt)
    r = random.Random(8)
    texts = [(i, "".join(r.choice("abcé🙂 ") for _ in range(r.randrange(30)))) for i in range(120)] + [(500, None), (501, ""), (502, "ab" * 20_000), (1, "again")]
    names = ["a", "é", "ab", "🙂", "a b", "abcab", "cé🙂 a", "again", "zzz", "", None, "ab", "x" * 300, *(t[k : k + n] for _, t in texts[:40] for k, n in ((3, 6), (1, 9)))]
    found = grams.containing(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame([(n, 1) for n in names], "name string, text int"))
    want = {(i, n) for i, t in texts for n in names if n and t and n in t}
    rows = [tuple(x) for x in found.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert grams.containing(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame([], "name string")).count() == 0


def test_gapless_histories(spark, sf):
    q = queries()
    for name in ("client_versions", "client_versions_merged"):
        assert history.broken_chains(q[name](spark, sf), ["client_id"]).count() == 0


def test_no_two_fetches_within_the_delay(spark, sf):
    from pyspark.sql import Window

    found = queries()["fetch_schedule"](spark, sf).withColumn("us", micros("starts_at"))
    w = Window.partitionBy("client_id").orderBy("us")
    assert found.withColumn("gap", F.col("us") - F.lag("us").over(w)).where("gap < 30000000").count() == 0
