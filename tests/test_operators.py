"""Operators on tiny tables, with results worked out by hand or by plain Python."""

import datetime as dt
import hashlib
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from narrata.functions import text
from narrata.operators import evidence, grams, graph, queue, retrieval, seeds, snapshot
from narrata.sources import records


def one(df):
    return [tuple(r) for r in df.collect()]


def strings(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def chunks_by_hand(t, size, overlap):
    out, start, step = [], 0, size - overlap
    while start < len(t):
        end = min(start + size, len(t))
        if end < len(t):
            last = t[start:end].rfind(" ")
            end = start + last if last > size // 2 else end
        out.append((start, end, t[start:end]))
        if end >= len(t):
            break
        start += step
    return out


def test_chunks_of_a_run_of_letters(spark):
    got = one(text.chunks(strings(spark, "A" * 300), "t", 100, 20).select("start_offset", "end_offset").orderBy("start_offset"))
    assert got == [(0, 100), (80, 180), (160, 260), (240, 300)]


def test_chunks_equal_a_loop(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("ab é ") for _ in range(r.randrange(0, 90))) for _ in range(150)]
    got = {}
    for row in text.chunks(strings(spark, *texts), "t", 20, 6, None).collect():
        got.setdefault(row["i"], []).append((row["start_offset"], row["end_offset"], row["content"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == chunks_by_hand(t, 20, 6), t


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (10, -1), (10, 10)])
def test_chunk_sizes_are_checked(spark, size, overlap):
    with pytest.raises(ValueError):
        text.chunks(strings(spark, "a"), "t", size, overlap)


def test_truncation_keeps_whole_characters(spark):
    texts = ["abc", "aé漢🙂z" * 4, "漢" * 9, "🙂" * 7, "a" * 50, ""]
    for limit in range(1, 14):

        def by_hand(t, limit=limit):
            data = t.encode()
            if len(data) <= limit:
                return t
            try:
                return data[:limit].decode()
            except UnicodeDecodeError:
                return data[:limit][:-3].decode(errors="ignore")

        got = dict(one(strings(spark, *texts).select("i", text.truncate_bytes(F.col("t"), limit))))
        assert [got[i] for i in range(len(texts))] == [by_hand(t) for t in texts], limit


def test_redaction(spark):
    got = one(strings(spark, "mail A.b@c.org or 555-123-4567", "4111 1111 1111 1111 and token=abcdefgh12", None).orderBy("i").select(text.redact(F.col("t"))))
    assert got == [("mail [EMAIL_REDACTED] or [PHONE_REDACTED]",), ("[CC_REDACTED] and [SECRET_REDACTED]",), (None,)]


def test_record_redaction(spark):
    df = spark.createDataFrame([({"Authorization": "x", "Accept": "y"}, "http://a/?key=1&b=2", 'x password="hunter2222"')], "h map<string,string>, u string, p string")
    headers, url, payload = one(df.select(text.redact_headers(F.col("h")), text.redact_url(F.col("u")), text.redact_payload(F.col("p"))))[0]
    assert headers == {"Authorization": "[REDACTED]", "Accept": "y"} and url == "http://a/?key=[REDACTED]&b=2" and "hunter" not in payload


def test_canonical_json():
    assert text.canonical('{"b": 1, "a": [1.0, 0.1, "e\\u0301"]}') == '{"a":[1.0,0.1,"é"],"b":1}'
    assert text.canonical("nope") is None and text.canonical(None) is None


def test_content_hash_is_of_the_content(spark):
    df = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":2, "b":1}',), ('{"a":3}',)], "r string")
    got = [x for (x,) in one(df.select(text.content_hash(F.lit("http"), F.lit("s"), F.lit("e"), F.lit("k"), F.lit(None).cast("string"), F.col("r"))))]
    body = {"entity_type": "e", "exchange_type": "http", "natural_key": "k", "request": None, "response": {"a": 2, "b": 1}, "source_system": "s"}
    assert got[0] == got[1] != got[2]
    assert got[0] == hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_natural_uuid(spark):
    got = one(strings(spark, "x").select(text.natural_uuid("dbo.T", F.col("t"), F.col("i"))))
    assert got == [(str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_DNS, "dbo.T"), '["x", "0"]')),)]


def test_row_hash_marks_nulls_and_booleans(spark):
    df = spark.createDataFrame([(True, None, 3)], "b boolean, a string, c int")
    assert one(df.select(text.row_hash(df, ("c",)))) == [(hashlib.sha256(b"a=NULL|b=1").hexdigest(),)]


def test_evidence_ids_and_names(spark):
    h = hashlib.sha256(b"src").hexdigest()[:12]
    kinds = ["inline_text", "lake_http", "sql_result", "doc_chunk", "sql_query_def", "other"]
    got = [x for (x,) in one(strings(spark, *kinds).orderBy("i").select(text.evidence_id(F.col("t"), F.lit("src"), F.lit(2))))]
    assert got == ["inline:2", f"lake:{h}:2", f"sql:{h}:2", f"doc:{h}:2", f"sqldef:{h}", f"other:{h}:2"]
    assert one(strings(spark, "a/b\\c:d" + "x" * 200).select(text.safe_name(F.col("t"))))[0][0] == "a_b_c_d" + "x" * 93


def test_link_rank(spark):
    titles = spark.createDataFrame([(1, "Star"), (2, "Luke"), (3, "Vader"), (9, "Luke")], "page_id long, title string")
    links = spark.createDataFrame([(t,) for t in ("Luke", "Vader", "Force", "Vader", "Yoda", "Force", "Luke", "Empire", "luke")], "target string")
    got = one(graph.link_rank(titles, links).select("title", "page_id", "inbound").orderBy(F.desc("inbound"), "title"))
    assert got == [("Force", None, 2), ("Luke", 2, 2), ("Vader", 3, 2), ("Empire", None, 1), ("Yoda", None, 1), ("luke", None, 1), ("Star", 1, 0)]
    assert graph.content_seeds(graph.link_rank(titles, links), "w", "n").count() == 6


def test_discovery_stops_at_the_depth(spark):
    rows = spark.createDataFrame([("s", "n", "a", 10, 0, ["x", None]), ("s", "n", "b", 10, 1, ["y"])], "source_system string, source_name string, resource_id string, priority int, depth int, refs array<string>")
    assert one(graph.discover(rows, F.col("refs"), "work").select("resource_id", "priority", "depth", "discovered_from")) == [("x", 20, 1, "a")]


def test_crawl_and_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (4, 5)], "source long, target long")
    got = dict(one(graph.crawl(spark.createDataFrame([(1,)], "node long"), edges, 2)))
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}
    tree = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "node string, parent string")
    assert sorted(one(graph.closure(tree).where("distance = 2"))) == [("c", "a", 2)]


def test_entity_match(spark):
    works = spark.createDataFrame([(1, "The Death Star", ["x"], "w1"), (2, "None", ["Sith"], "w2"), (3, "None", [], "doi3"), (4, None, None, None)], "work_id long, title string, concepts array<string>, identifier string")
    entities = spark.createDataFrame([("death star",), ("sith",), (None,)], "entity string")
    ids = spark.createDataFrame([("doi3",)], "identifier string")
    assert sorted(one(graph.match_entities(works, entities, ids))) == [(1,), (2,), (3,)]
    assert one(graph.match_entities(works, entities, case_sensitive=True)) == []
    got = one(strings(spark, "https://doi.org/10.1/x", "http://o.org/W12", "W12").orderBy("i").select(graph.clean_identifier(F.col("t"))))
    assert got == [("10.1/x",), ("W12",), ("W12",)]


def test_enqueue_takes_new_keys_once(spark):
    known = spark.createDataFrame([("a",)], "dedupe_key string")
    items = spark.createDataFrame([("a", 1), ("b", 5), ("b", 2)], "dedupe_key string, priority int")
    assert one(queue.enqueue(known, items)) == [("b", 2)]


@pytest.mark.parametrize(("attempt", "outcome", "status", "wait"), [(1, "FAILED", "NEW", 60), (2, "FAILED", "NEW", 120), (3, "FAILED", "DEADLETTER", None), (1, "SUCCEEDED", "SUCCEEDED", None)])
def test_complete_job(spark, attempt, outcome, status, wait):
    t = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(attempt, 3, t, outcome, "e")], "attempt_count int, max_attempts int, available_utc timestamp_ntz, outcome string, error string")
    row = queue.complete(jobs, "outcome", "error", "TIMESTAMP_NTZ '2024-02-01 00:00:00'").first()
    assert row["status"] == status and row["last_error"] == ("e" if outcome == "FAILED" else None)
    assert row["available_utc"] == (t if wait is None else dt.datetime(2024, 2, 1) + dt.timedelta(seconds=wait))


def test_fetch_outcome_keeps_attempts(spark):
    df = spark.createDataFrame([(200, 1), (500, 0), (404, 2)], "code int, attempt int")
    assert one(df.select(*queue.after_fetch(F.col("code"), F.col("attempt")))) == [("completed", 1), ("pending", 1), ("failed", 3)]


def test_conflicts(spark):
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(a, a), (a, b), (b, a), (a, None), (None, a), (None, None)], "j timestamp_ntz, s timestamp_ntz")
    got = [x for (x,) in one(df.select(snapshot.resolve("prefer_newest", F.col("j"), F.col("s"))))]
    assert got == ["json_wins", "sql_wins", "json_wins", "json_wins", "sql_wins", "json_wins"]
    assert one(df.limit(1).select(snapshot.resolve("fail", F.col("j"), F.col("s")))) == [("failed",)]
    with pytest.raises(ValueError):
        snapshot.resolve("other", F.col("j"), F.col("s"))


def test_import_replaces_all_rows_of_a_key(spark):
    cols = "record_id long, natural_key string, content_sha256 string, observed_at timestamp_ntz"
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    json_side = spark.createDataFrame([(1, "k", "h1", t[2]), (2, "n", "h2", t[0]), (3, "z", "s1", t[0]), (4, None, "h4", t[0])], cols)
    sql_side = spark.createDataFrame([(10, "k", "s1", t[0]), (11, "k", "s2", t[1]), (12, "q", "s3", t[1])], cols)
    plan = snapshot.import_plan(json_side, sql_side)
    assert dict(one(plan.select("record_id", "action"))) == {1: "update", 2: "insert", 3: "skip", 4: "insert"}
    assert sorted(r["record_id"] for r in snapshot.apply_import(plan, sql_side).collect()) == [1, 2, 4, 12]
    assert sorted(r["record_id"] for r in snapshot.to_export(sql_side, json_side).collect()) == [11, 12]


def test_bundle_is_greedy_and_passes_over(spark):
    items = spark.createDataFrame([("b", i, i, n) for i, n in enumerate((50, 60, 30, 40))], "bundle string, o int, item_id int, n int")
    assert one(evidence.bound_bundles(items, "bundle", ["o"], "n", max_bytes=100)) == [("b", [0, 2], 80)]
    assert one(evidence.bound_bundles(items, "bundle", ["o"], "n", max_items=1)) == [("b", [0], 50)]


@pytest.mark.parametrize(("how", "most", "rows"), [("first_only", 3, [0, 1, 2]), ("first_last", 4, [0, 1, 8, 9]), ("first_last", 1, list(range(10))), ("stride", 3, [0, 3, 6]), ("stride", 20, list(range(10)))])
def test_sampling(spark, how, most, rows):
    df = spark.createDataFrame([("g", i) for i in range(10)], "g string, i int")
    assert sorted(r["i"] for r in evidence.sample_rows(df, "g", ["i"], most, how).collect()) == rows


def test_fact_checks(spark):
    good = {"entity_type": "c", "entity_id": "1", "facts": [{"fact_key": "k", "confidence": 0.5}]}
    cases = [good, {**good, "facts": [{"fact_key": "k", "confidence": 1.5}]}, {"entity_type": "c", "facts": []}, {"entity_type": "c", "entity_id": "1"}]
    got = [r["fault"] for r in evidence.check_facts(strings(spark, *map(json.dumps, cases), "no json"), "t").orderBy("i").collect()]
    assert got == [None, "bad fact", "missing field", "no facts", "not an output"]


def test_cosine_and_top_k(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert [x for (x,) in one(df.select(retrieval.cosine(F.col("a"), F.col("b"))))] == [1, 0, -1, 0, None, None]
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    rows = spark.createDataFrame([("c", [2.0, 0.0]), ("a", [1.0, 0.0]), ("b", [3.0, 0.0]), ("d", [0.0, 1.0]), ("e", [-1.0, 0.0]), ("f", [1.0])], "chunk_id string, vector array<double>")
    assert one(retrieval.top_k(queries, rows, 9).select("chunk_id", "rank").orderBy("rank")) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert retrieval.top_k(queries, rows, 9, 0.5).count() == 3


def test_index_takes_what_changed(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "new"), (3, "unseen")], "source_id long, content string")
    registry = docs.where("source_id < 3").select("source_id", F.when(F.col("source_id") == 1, F.sha2("content", 256)).otherwise("old").alias("content_sha256"))
    assert sorted(r["source_id"] for r in retrieval.to_index(docs, registry).collect()) == [2, 3]


def test_seed_checks(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, n string")
    assert one(seeds.duplicates(rows, "n")) == [("a", 2)]
    assert seeds.unknown_columns(rows, rows.select("k")) == ["n"]
    assert one(seeds.orphans(rows, "n", rows.where("false"), "n").select("k").orderBy("k")) == [(1,), (2,)]
    assert seeds.load_order({"c": {"b"}, "b": {"a", "b"}, "a": set()}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        seeds.load_order({"a": {"b"}, "b": {"a"}})
    assert seeds.prepare(rows, "dbo.T", ["k"], "G", {"n": "none"}).where("n = 'none'").count() == 1


def test_addresses_and_seeds(spark):
    from narrata.operators import ingest

    sources = {"w": {"type": "mediawiki", "api_url": "http://w/api.php"}, "o": {"type": "openalex", "api_url": "http://o"}}
    config = [
        {"source": "w", "titles": ["Luke S", "Luke S"], "priority": 3},
        {"source": "o", "resource_type": "work", "work_ids": ["12", "W7"], "dois": ["10.1/x"]},
        {"source": "o", "resource_type": "search", "search_query": "star wars"},
        {"source": "none", "titles": ["x"]},
        {"source": "w"},
    ]
    got = {r["resource_id"]: (r["request_uri"], r["priority"]) for r in ingest.seed_items(spark, config, sources).collect()}
    assert got == {
        "Luke S": ("http://w/api.php?action=query&format=json&titles=Luke+S&prop=links&pllimit=500", 3),
        "W12": ("http://o/works/W12", 10),
        "W7": ("http://o/works/W7", 10),
        "10.1/x": ("http://o/works/doi:10.1%2Fx", 10),
        "star wars": ("http://o/works?search=star+wars", 10),
    }
    urls = one(strings(spark, "http://o/works", "http://o/works?a=1", "http://o?mailto=x").orderBy("i").select(ingest.polite(F.col("t"), "me@x.org")))
    assert urls == [("http://o/works?mailto=me%40x.org",), ("http://o/works?a=1&mailto=me%40x.org",), ("http://o?mailto=x",)]


def test_http_text(spark):
    from narrata.operators import ingest

    df = spark.createDataFrame([(200, "OK", "http://x", {"date": "d", "x": "y"}, "b" * 5000), (None, None, None, None, None)], "s int, r string, u string, h map<string,string>, b string")
    first, second = (x for (x,) in one(df.select(ingest.http_text(F.col("s"), F.col("r"), F.col("u"), F.col("h"), F.col("b"), 500))))
    assert first == "HTTP 200 OK\nURL: http://x\ndate: d\n\n--- Response Body ---\n" + "b" * 1000
    longer = one(df.limit(1).select(ingest.http_text(F.col("s"), F.col("r"), F.col("u"), F.col("h"), F.col("b"), 2345)))[0][0]
    assert longer.split("---\n")[1] == "b" * (2345 - 100 - len("HTTP 200 OK\nURL: http://x\ndate: d"))
    assert second == "HTTP UNKNOWN \nURL: unknown\n\n--- Response Body ---\n"


@pytest.mark.parametrize("sql", ["DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE VIEW v AS SELECT 1", "SET a=b"])
def test_only_queries_run(spark, sql):
    from narrata.operators import ingest

    with pytest.raises(ValueError):
        ingest.run_select(spark, sql)
    assert ingest.run_select(spark, "SELECT * FROM range(10)", 3).count() == 3


def test_library_ships_itself(spark, monkeypatch, tmp_path):
    import __spark_entry__ as e

    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("PYTHONPATH", raising=False)
    assert e.queries()["learn_scenes"](spark, "/root/testdata/sf0.001").count() > 0
    assert spark.sparkContext.applicationId in e._SHIPPED


def test_wiki_payloads(spark):
    from narrata.operators import ingest

    object_form = {"query": {"pages": {"5": {"pageid": 5, "title": "Star", "links": [{"title": "Luke"}, {"title": "Luke"}], "categories": [{"title": "C"}]}, "-1": {"title": "gone", "links": [{"title": "no"}]}}}}
    list_form = {"query": {"pages": [{"pageid": 6, "title": "Luke", "links": [{"title": "Star"}]}, {"pageid": 7, "title": "Bare"}]}}
    rows = [(json.dumps(x), "s", "n", "id", 10, d) for x, d in ((object_form, 0), (list_form, 0), (list_form, 1), ({}, 0))] + [("not json", "s", "n", "id", 10, 0)]
    df = spark.createDataFrame(rows, "payload string, source_system string, source_name string, resource_id string, priority int, depth int")
    assert sorted(one(ingest.wiki_edges(df.where("depth = 0")))) == [(5, "Star", "Luke"), (5, "Star", "Luke"), (6, "Luke", "Star")]
    got = one(ingest.wiki_children(df).select("resource_type", "resource_id", "priority", "depth"))
    assert sorted(got) == [("category", "C", 30, 1), ("page", "Luke", 20, 1), ("page", "Luke", 20, 1), ("page", "Star", 20, 1)]
    assert one(strings(spark, "A b").select(ingest.wiki_request("http://w", "categories", F.col("t")))) == [("http://w?action=query&format=json&titles=A+b&prop=categories&cllimit=500",)]


def test_citation_payloads(spark):
    from narrata.operators import ingest

    work = {"id": "https://o.org/W1", "doi": "https://doi.org/10.1/a", "display_name": "T", "concepts": [{"display_name": "Sith"}], "referenced_works": ["https://o.org/W2", "W3"]}
    df = strings(spark, json.dumps(work), json.dumps({"results": [work, {**work, "id": "W9", "doi": None}]}), "x").withColumnRenamed("t", "payload")
    got = sorted(one(ingest.cited_works(df).select("i", "work_id", "identifier", "title", "concepts", "refs")))
    assert got == [(0, "W1", "10.1/a", "T", ["Sith"], ["W2", "W3"]), (1, "W1", "10.1/a", "T", ["Sith"], ["W2", "W3"]), (1, "W9", None, "T", ["Sith"], ["W2", "W3"])]


def test_policies_and_items(spark):
    assert evidence.policy_faults({}) == []
    assert len(evidence.policy_faults({"max_items": 0, "max_total_bytes": 10, "max_item_bytes": 50, "max_sql_rows": 0, "chunk_size": 50, "chunk_overlap": 60, "sampling_strategy": "x"})) == 8
    rows = [("b", 0, "inline_text", "r", "a@b.org " * 3), ("b", 1, "lake_http", "r", "a@b.org " * 3), ("b", 2, "sql_query_def", "r", "a@b.org"), ("b", 3, "other", None, None)]
    df = spark.createDataFrame(rows, "bundle string, source_ordinal int, evidence_type string, source_ref string, text string")
    got = [r["content"] for r in evidence.load_items(df, 18).orderBy("source_ordinal").collect()]
    assert got == ["[EMAIL_REDACTED] [", "[EMAIL_REDACTED] [EMAIL_REDACTED] a@", "a@b.org", ""]


def test_embedding_tables(spark):
    e = spark.createDataFrame([("c1", "m", "h1"), ("c1", "m", "h1"), ("c2", "m", "h2"), ("c3", "n", "h3")], "chunk_id string, model string, vector_sha256 string")
    chunks = spark.createDataFrame([("c1", "doc", 5), ("c2", "web", 7)], "chunk_id string, source_type string, byte_count int")
    assert sorted(r["chunk_id"] for r in retrieval.new_embeddings(e, e.where("chunk_id = 'c2'")).collect()) == ["c1", "c3"]
    assert [r["chunk_id"] for r in retrieval.candidates(e, chunks, "m", ["web"]).collect()] == ["c2"]
    assert tuple(retrieval.index_manifest(e, e.limit(1), chunks).select("sources", "indexed", "chunks", "bytes", "skipped").first()) == (4, 1, 2, 12, 3)


def test_closure_has_no_depth_limit_and_refuses_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "node long, parent long")
    found = {(r["node"], r["ancestor"]): r["distance"] for r in graph.closure(chain).collect()}
    assert len(found) == 40 * 41 // 2 and all(d == n - a for (n, a), d in found.items())
    with pytest.raises(ValueError, match="cycle"):
        graph.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"))


def test_names_in_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(grams, "DEALT", 1)  # several parts
    titles = ["x " * 5000 + "Tatooine end", "nothing here", None, "alDERaan", ""]
    works = spark.createDataFrame([(i, t, ["hoth"] if i == 1 else None, f"id{i}") for i, t in enumerate(titles)], "work_id long, title string, concepts array<string>, identifier string")
    entities = spark.createDataFrame([("tatooine",), ("Alderaan",), ("Hoth",), ("",), (None,), ("zz",)], "entity string")
    found = lambda *a, **k: sorted(r["work_id"] for r in graph.match_entities(works, entities, *a, **k).collect())
    assert found() == [0, 1, 3]
    assert found(spark.createDataFrame([("id4",)], "identifier string")) == [0, 1, 3, 4]
    assert found(case_sensitive=True) == []


def test_cited_works_lead_on_from_matches_only(spark):
    rows = [("W1", "on Hoth", ["W7", "W8"], 0), ("W2", "elsewhere", ["W9"], 0), ("W3", "Hoth again", ["W7"], 1)]
    works = spark.createDataFrame([(w, t, [], None, r, d, 10, "api", "works") for w, t, r, d in rows], "work_id string, title string, concepts array<string>, identifier string, refs array<string>, depth int, priority int, source_system string, source_name string")
    got = graph.discover_cited(works, spark.createDataFrame([("hoth",)], "entity string")).collect()
    assert sorted((r["resource_id"], r["depth"], r["priority"], r["discovered_from"]) for r in got) == [("W7", 1, 20, "W1"), ("W8", 1, 20, "W1")]


def test_appended_records_and_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "2024-01-01 10:00:00", 3), ("r2", "2024-01-02 09:00:00", 4)], "run_id string, created_utc string, items int").withColumn("created_utc", F.col("created_utc").cast("timestamp"))
    for _ in range(2):
        records.append_records(rows, str(tmp_path / "records"), "run_id")
    assert spark.read.parquet(str(tmp_path / "records")).count() == 4
    records.write_manifests(rows, str(tmp_path / "manifests"))
    schema = "run_id string, created_utc timestamp, items int, day date"
    assert [r["run_id"] for r in records.read_manifests(spark, str(tmp_path / "manifests"), schema).collect()] == ["r2", "r1"]
    assert [r["run_id"] for r in records.read_manifests(spark, str(tmp_path / "manifests"), schema, "2024-01-02").collect()] == ["r2"]


def test_runs_that_ended_stay(spark):
    at = lambda m: F.lit(f"2024-02-01 00:0{m}:00").cast("timestamp_ntz")
    runs = queue.start_runs(spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "job_id long, attempt_count int"), at(0))
    said = spark.createDataFrame([("1:1", "SUCCEEDED", None), ("1:1", "FAILED", "x"), ("2:1", "SUCCEEDED", "fine")], "run_id string, outcome string, message string")
    ended = queue.end_runs(runs, said, at(5))
    again = queue.end_runs(ended, said.withColumn("outcome", F.lit("FAILED")), at(9))
    got = {r["run_id"]: (r["status"], r["error"], r["completed_utc"] and r["completed_utc"].minute) for r in again.collect()}
    assert got == {"1:1": ("FAILED", "x", 5), "2:1": ("SUCCEEDED", None, 5), "3:2": ("RUNNING", None, None)}


def test_sampled_columns(spark):
    rows = spark.createDataFrame([(1, i, i) for i in range(9)], "g int, a int, b int")
    assert evidence.sample_rows(rows, "g", ["a"], 4, "first_last", 2).columns == ["g", "a"]


def test_natural_uuids_of_odd_keys(spark):
    keys = ["", "a\"b\\c/d", "é🙂\x7f", "tab\tnew\nline\r\b\f", "".join(map(chr, range(1, 32))), "\\u000b \x0b", None]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    got = [r[0] for r in df.orderBy("i").select(text.natural_uuid("dbo.T", F.col("k"), F.col("i"))).collect()]
    base = uuid.uuid5(uuid.NAMESPACE_DNS, "dbo.T")
    assert got == [str(uuid.uuid5(base, json.dumps([str(k), str(i)], ensure_ascii=False))) for i, k in enumerate(keys)]
