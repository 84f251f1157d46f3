"""JSON columns, sketches, samples, observed runs, evidence from results, prompts, lake folders and stored tables, against brute force."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from narrata.functions import documents
from narrata.operators import evidence, observed, sampling, sketches
from narrata.sources import records, warehouse

TEXTS = ['{"b": 1, "a": {"y": [1, 2.5, null, "é"], "x": "t"}}', '{"b": "7", "a": 3}', "[1, 2]", "3", '"é"', "{broken", "", None, '{"b": 12345678901234567890}', '{"b": 1, "b2": ' + "[" * 40 + "]" * 40 + "}"]


def test_attributes(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "i int, doc string, x string")
    found = documents.attributes(df.drop("x"), "doc", {"b": ("$.b", "int"), "y0": ("$.a.y[0]", "int"), "x": ("$.a.x", "string")}).orderBy("i").collect()
    assert [r["b"] for r in found] == [1, 7, None, None, None, None, None, None, None, 1]
    assert (found[0]["y0"], found[0]["x"], found[1]["x"]) == (1, "t", None)
    assert [r["doc_fault"] for r in found] == [None] * 5 + ["broken", "broken", "missing", None, None]
    assert documents.attributes(df.limit(0), "doc", {"b": ("$.b", "int")}).count() == 0


def test_shape_and_canonical(spark):
    df = spark.createDataFrame([("g", t) for t in TEXTS[:2]] + [("h", "{broken"), ("h", None)], "k string, doc string")
    found = {r["k"]: r for r in documents.shape(df, "doc", "k").collect()}
    assert found["g"]["shape"].startswith("OBJECT<a: VARIANT, b: VARIANT>") and (found["g"]["n"], found["g"]["broken"]) == (2, 0)
    assert (found["h"]["n"], found["h"]["broken"]) == (1, 1)
    texts = [r[0] for r in df.select(documents.canonical("doc")).collect()]
    assert texts == ['{"a":{"x":"t","y":[1,2.5,null,"é"]},"b":1}', '{"a":3,"b":"7"}', None, None]


def test_readable(spark):
    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t), indent=2)
        except ValueError:
            return t

    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in df.select(documents.readable("t")).collect()] == [one(t) for t in TEXTS]
    assert [r[0] for r in df.select(documents.readable("t", 9)).collect()][:2] == [one(t)[:9] for t in TEXTS[:2]]


def test_sketches_merge_within_their_bounds(spark):
    r = random.Random(1)
    rows = [(d, "hot" if r.random() < 0.3 else f"i{r.randrange(3000)}", r.random()) for d in range(6) for _ in range(5000)] + [(0, None, None)]
    df = spark.createDataFrame(rows, "day int, item string, value double")
    daily = sketches.sketched(df, ["day"], "item", "value").withColumn("g", F.lit("all"))
    found = sketches.merged(daily, ["g"], [0.1, 0.5, 0.99], 3).first()
    items, values = {x for _, x, _ in rows if x}, sorted(v for *_, v in rows if v is not None)
    assert found["n"] == len(rows) and abs(found["n_items"] - len(items)) <= 0.05 * len(items)
    for q, name in ((0.1, "q_10"), (0.5, "q_50"), (0.99, "q_99")):
        assert abs(sum(v <= found[name] for v in values) / len(values) - q) <= 0.03
    assert found["top"][0]["item"] == "hot" and found["top"][0]["count"] == sum(x == "hot" for _, x, _ in rows)
    assert sketches.merged(daily.limit(0), ["g"], [0.5]).count() == 0


def test_samples_of_exact_size(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}" if i % 5 else None, "clash") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, s string, _x string")
    for k in (0, 1, 30):
        draws = [sorted(map(tuple, sampling.bottom_k(d, ["s"], ["id"], k, "salt").collect()), key=repr) for d in (df, df.repartition(7), df.repartition(3, "s"))]
        assert draws[0] == draws[1] == draws[2]
        groups, got = defaultdict(int), defaultdict(int)
        for _, s, _ in rows:
            groups[s] += 1
        for _, s, _ in draws[0]:
            got[s] += 1
        assert got == {s: min(k, n) for s, n in groups.items() if k}
    small, large = (set(map(tuple, sampling.bottom_k(df, ["s"], ["id"], k).collect())) for k in (5, 9))
    assert small < large
    plan = sampling.bottom_k(df, ["s"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    with pytest.raises(ValueError):
        sampling.bottom_k(df, ["s"], ["id"], -1)


def test_metrics_of_the_very_run(spark, tmp_path):
    df = spark.range(1000).withColumn("ok", F.col("id") % 4 == 0)
    found = observed.written(df, str(tmp_path / "out"), {"n": F.count(F.lit(1)), "ok": F.count_if("ok"), "most": F.max("id")})
    assert found == {"n": 1000, "ok": 250, "most": 999} and spark.read.parquet(str(tmp_path / "out")).count() == 1000
    assert observed.written(df.limit(0), str(tmp_path / "none"), {"n": F.count(F.lit(1)), "most": F.max("id")}) == {"n": 0, "most": None}


def test_metrics_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    watch = observed.Progress()
    spark.streams.addListener(watch)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("seen", F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        import time

        for _ in range(100):
            if sum(b[2] for b in watch.batches) == 30:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    assert sum(b[2] for b in watch.batches) == 30 and sum(b[3]["seen"]["total"] for b in watch.batches) == sum(range(30))


def result_text(rows, columns, max_rows, max_cols, how):
    shown = columns[:max_cols] if max_cols else columns
    lines = [f"SQL Result Set ({len(rows)} rows, {len(columns)} columns)", f"Columns: {', '.join(shown)}"]
    if len(shown) < len(columns):
        lines.append(f"(Note: Showing {len(shown)} of {len(columns)} columns)")
    half, stride = max_rows // 2, max(len(rows) // max_rows, 1)
    if len(rows) <= max_rows:
        taken, note = rows, "All rows included"
    elif how == "first_only":
        taken, note = rows[:max_rows], f"First {max_rows} rows of {len(rows)}"
    elif how == "first_last":
        taken, note = rows[:half] + rows[-half:], f"First {half} and last {half} rows of {len(rows)}"
    else:
        taken = rows[::stride][:max_rows]
        note = f"Every {stride}th row (sampled {len(taken)} of {len(rows)})"
    body = [f"Row {i}: {json.dumps(dict(zip(shown, r)), ensure_ascii=False)}" for i, r in enumerate(taken)]
    return "\n".join([*lines, "", f"Sampling: {note}", "", *body]), len(taken)


@pytest.mark.parametrize("how", ["first_only", "first_last", "stride"])
def test_texts_of_results(spark, how):
    rows = [(f"q{n}", i, f'v"{i}\né' if i % 3 else None, 0.5 * i) for n in (1, 4, 5, 23) for i in range(n)]
    df = spark.createDataFrame(rows, "ref string, i int, v string, x double").repartition(4)
    found = {r["ref"]: r for r in evidence.result_texts(df, "ref", ["i"], ["i", "v", "x"], 4, 2, how).collect()}
    for n in (1, 4, 5, 23):
        own = [r[1:] for r in rows if r[0] == f"q{n}"]
        text, sampled = result_text(own, ["i", "v", "x"], 4, 2, how)
        assert found[f"q{n}"]["text"] == text and (found[f"q{n}"]["total_rows"], found[f"q{n}"]["sampled_rows"]) == (n, sampled)
    assert evidence.result_texts(df.limit(0), "ref", ["i"], ["i"]).count() == 0


def test_stored_results(spark):
    texts = [("a.json", '{"columns": ["n", "s"], "rows": [[1, "x"], [2.5, null], [3, "y", "beyond"]], "row_count": 3}'), ("b.json", "no result"), ("c.json", '{"columns": [], "rows": []}'), ("d.json", None)]
    cells = [tuple(r) for r in evidence.stored_results(spark.createDataFrame(texts, "lake_uri string, text string")).collect()]
    assert sorted(cells) == [("a.json", 0, 0, "n", "1"), ("a.json", 0, 1, "s", '"x"'), ("a.json", 1, 0, "n", "2.5"), ("a.json", 1, 1, "s", "null"), ("a.json", 2, 0, "n", "3"), ("a.json", 2, 1, "s", '"y"')]


def test_prompts(spark):
    jobs = spark.createDataFrame([("1", "k", "ship", "{evidence_content}"), ("2", "k", "hut", None), ("3", "none", "x", "y")], "job_id string, interrogation_key string, entity_type string, entity_id string")
    registry = spark.createDataFrame([("k", 1, "old"), ("k", 2, "{entity_type}/{entity_id}: {evidence_content} {other} {entity_type}")], "interrogation_key string, version int, prompt_template string")
    items = spark.createDataFrame([("1", 2, "b", "inline_text", "second {entity_id}"), ("1", 1, "a", "lake_text", None), ("9", 1, "a", "x", "y")], "job_id string, source_ordinal int, item_id string, evidence_type string, content string")
    found = {r["job_id"]: r for r in evidence.prompts(jobs, registry, items).collect()}
    parts = "\n".join(["--- Evidence [a] (type: lake_text) ---\n\n", "--- Evidence [b] (type: inline_text) ---\nsecond {entity_id}\n"])
    assert set(found) == {"1", "2"}
    assert found["1"]["prompt"] == f"ship/{{evidence_content}}: {parts} {{other}} ship" and found["1"]["n_items"] == 2
    assert found["2"]["prompt"] == "hut/: [No evidence provided] {other} hut" and found["2"]["n_items"] == 0


def test_dated_lake_folders(spark, tmp_path):
    root = str(tmp_path / "lake")
    rows = spark.createDataFrame([("run/1", "2024-03-09 01:00:00", "one"), ("run/1", "2024-03-09 02:00:00", "two"), ("r2", "2024-12-31 23:59:59", None)], "run_id string, created_utc string, body string")
    records.write_artifacts(rows.withColumn("created_utc", F.col("created_utc").cast("timestamp")), root)
    folders = {str(p.relative_to(root)) for p in (tmp_path / "lake").rglob("run=*")}
    assert folders == {"year=2024/month=03/day=09/run=run_1", "year=2024/month=12/day=31/run=r2"}
    texts = {r["lake_uri"]: r["text"] for r in records.read_texts(spark, root, "*.json").collect()}
    assert {u.rpartition("/")[0] for u in texts} == folders and sum(len(t.splitlines()) for t in texts.values()) == 3
    assert all((tmp_path / "lake" / u).read_text() == t for u, t in texts.items())


def test_a_stored_table_whose_files_are_gone_is_made_again(spark, sf):
    """A catalog entry never stands for files that went."""
    from narrata.sources.shared import forget

    before = warehouse.Warehouse(spark, sf)["DimScene"].count()
    name = warehouse.Warehouse(spark, sf)._stored("DimScene")
    where = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
    forget(spark, where)
    spark.catalog.refreshTable(name)
    assert warehouse.Warehouse(spark, sf)["DimScene"].count() == before > 0


def test_stored_tables_belong_to_the_application(spark, sf):
    name = warehouse.Warehouse(spark, sf)._stored("DimScene")
    assert spark.sparkContext.applicationId.replace("-", "_").lower() in name
