"""Queries of the corpus operators over the generated tables, each with its oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.functions import text
from narrata.operators import evidence, graph, ingest, queue, relational, retrieval, seeds, snapshot
from narrata.sources.shared import scratch
from narrata.sources.warehouse import BASE, Warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; it gets the tables of a folder."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, d: f(Warehouse(spark, d))
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_HREF = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
_RANK = f"""WITH t AS (SELECT url AS title, min(page_id) AS page_id FROM pages GROUP BY 1), l AS (SELECT unnest({_HREF}) AS title FROM pages),
    c AS (SELECT title, count(*) AS n FROM l GROUP BY 1), r AS (SELECT title, page_id, coalesce(n, 0) AS inbound FROM t FULL JOIN c USING (title)) """


def _ranked(w) -> DataFrame:
    return graph.link_rank(w["pages"].select("page_id", F.col("url").alias("title")), graph.html_links(w["pages"]))


@query(_RANK + "SELECT * FROM r")
def link_rank(w):
    return _ranked(w)


@query(_RANK + "SELECT * FROM r ORDER BY inbound DESC, title LIMIT 20")
def top_linked(w):
    return graph.top_pages(_ranked(w), 20, with_id=False)


@query(
    _RANK
    + """SELECT 'wiki' AS source_system, 'pages' AS source_name, unnest(['raw', 'html']) AS resource_type, CAST(page_id AS VARCHAR) AS resource_id, 50 AS priority
    FROM (SELECT * FROM r WHERE page_id IS NOT NULL ORDER BY inbound DESC, title LIMIT 10)"""
)
def content_seeds(w):
    return graph.content_seeds(graph.top_pages(_ranked(w), 10), "wiki", "pages")


@query(f"""SELECT 'wiki' AS source_system, 'pages' AS source_name, 'page' AS resource_type, unnest({_HREF}) AS resource_id, 20 AS priority, 1 AS depth, url AS discovered_from FROM pages""")
def discover_links(w):
    records = w["pages"].select(F.lit("wiki").alias("source_system"), F.lit("pages").alias("source_name"), F.col("url").alias("resource_id"), "html", F.lit(10).alias("priority"), F.lit(0).alias("depth"))
    return graph.discover(records, F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), "page")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    r(node, depth) AS (SELECT 7, 0 UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 2)
    SELECT node, min(depth) AS depth FROM r GROUP BY node"""
)
def crawl_frontier(w):
    edges = w["orders"].join(w["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"))
    return graph.crawl(w.spark.createDataFrame([(7,)], "node long"), edges, 2)


@query(
    """WITH e AS (SELECT DISTINCT lower(entity) AS entity FROM (SELECT p_name AS entity FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT text FROM benchmark UNION ALL SELECT 'de') WHERE entity <> '')
    SELECT DISTINCT d.doc_id AS work_id FROM documents d WHERE EXISTS (SELECT 1 FROM e WHERE e.entity <> 'de' AND contains(lower(d.text), e.entity)) OR contains(lower(d.text), 'de') OR lower(d.lang) IN (SELECT entity FROM e) OR d.source = 'src7'"""
)
def entity_match(w):
    """Whole texts that name a part, a nation, or a whole benchmark item."""
    works = w["documents"].select(F.col("doc_id").alias("work_id"), F.col("text").alias("title"), F.array("lang").alias("concepts"), F.col("source").alias("identifier"))
    names = [w["part"].select(F.col("p_name").alias("entity")), w["nation"].select("n_name"), w["benchmark"].select("text"), w.spark.createDataFrame([("de",)], "entity string")]
    entities = names[0]
    for more in names[1:]:
        entities = entities.union(more)
    return graph.match_entities(works, entities, w.spark.createDataFrame([("src7",)], "identifier string"))


@query("SELECT url, CASE WHEN regexp_replace(url, '^https?://[^/]*example\\.org/', '') <> url THEN 1 ELSE 0 END AS is_org, list_extract(string_split(url, '/'), -1) AS last_part FROM pages")
def clean_identifiers(w):
    return w["pages"].select("url", F.regexp_like("url", F.lit(r"^https?://[^/]*example\.org/")).cast("int").alias("is_org"), graph.clean_identifier(F.col("url")).alias("last_part"))


@query("SELECT url, '10.5555/' || regexp_replace(lower(regexp_extract(url, '[^/]*$')), '[^a-z0-9]', '.', 'g') AS doi, list_extract(string_split(url, '/'), -1) AS plain FROM pages")
def clean_dois(w):
    """Identifiers behind resolvers of either kind, and addresses that are none."""
    doi = F.concat(F.lit("10.5555/"), F.regexp_replace(F.lower(F.regexp_extract("url", "[^/]*$", 0)), "[^a-z0-9]", "."))
    resolver = F.when(F.length("url") % 3 == 0, "https://doi.org/").when(F.length("url") % 3 == 1, "http://dx.doi.org/").otherwise("HTTPS://DOI.ORG/")
    return w["pages"].select("url", graph.clean_identifier(F.concat(resolver, doi)).alias("doi"), graph.clean_identifier(F.col("url")).alias("plain"))


def _items(w) -> DataFrame:
    return w["events"].select(
        text.dedupe_key(F.lit("sys"), F.lit("events"), F.col("event_type"), F.col("user_id").cast("string")).alias("dedupe_key"),
        (F.col("event_id") % 7).alias("priority"),
        "event_id",
        F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 3 == 1, "completed").otherwise("failed").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("attempt"),
    )


_ITEMS = """items AS (SELECT 'sys:events:' || event_type || ':' || CAST(user_id AS VARCHAR) AS dedupe_key, event_id % 7 AS priority, event_id, ts AS created_at,
    CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' ELSE 'failed' END AS status, CAST(event_id % 4 AS INT) AS attempt FROM events)"""


@query(f"""WITH {_ITEMS}, k AS (SELECT DISTINCT dedupe_key FROM items WHERE status = 'completed' AND priority = 1), n AS (SELECT dedupe_key, priority, event_id, row_number() OVER (PARTITION BY dedupe_key ORDER BY priority, event_id) AS i
    FROM items WHERE status <> 'completed' OR priority <> 1) SELECT dedupe_key, priority, event_id FROM n WHERE i = 1 AND dedupe_key NOT IN (SELECT dedupe_key FROM k)""")
def enqueue_dedupe(w):
    items, columns = _items(w), ["dedupe_key", "priority", "event_id"]
    return queue.enqueue(items.where("status = 'completed' AND priority = 1").select(*columns), items.where("status <> 'completed' OR priority <> 1").select(*columns))


@query(f"WITH {_ITEMS} SELECT * FROM items WHERE status = 'pending' ORDER BY priority, created_at, dedupe_key LIMIT 25")
def dequeue_batch(w):
    return queue.dequeue(_items(w), 25)


@query(f"WITH {_ITEMS} SELECT status, count(*) AS n FROM items GROUP BY status")
def queue_stats(w):
    return queue.stats(_items(w))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1")
def latest_version_filter(w):
    return queue.latest(w["events"], "user_id", "ts", "event_id")


@query(f"""WITH {_ITEMS} SELECT event_id, CASE WHEN status = 'completed' AND dedupe_key LIKE '%click%' THEN 'pending' ELSE status END AS status,
    CASE WHEN status = 'completed' AND dedupe_key LIKE '%click%' THEN 0 ELSE attempt END AS attempt FROM items""")
def recrawl_reset(w):
    items = _items(w).withColumn("kind", F.split("dedupe_key", ":")[2])
    return queue.reset_for_recrawl(items, kind="click", source=None).select("event_id", "status", "attempt")


@query(f"""WITH {_ITEMS}, c AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 500 WHEN 1 THEN 404 WHEN 2 THEN 200 WHEN 3 THEN 204 ELSE 301 END AS code FROM items)
    SELECT event_id, CASE WHEN code BETWEEN 200 AND 299 THEN 'completed' WHEN attempt + 1 < 3 THEN 'pending' ELSE 'failed' END AS new_status,
    CASE WHEN code BETWEEN 200 AND 299 THEN attempt ELSE attempt + 1 END AS new_attempt FROM c""")
def fetch_outcome(w):
    code = F.element_at(F.array(*map(F.lit, (500, 404, 200, 204, 301))), (F.col("event_id") % 5 + 1).cast("int"))
    status, attempt = queue.after_fetch(code, F.col("attempt"))
    return _items(w).select("event_id", status.alias("new_status"), attempt.alias("new_attempt"))


def _jobs(w) -> DataFrame:
    return w["events"].select(
        F.col("event_id").alias("job_id"),
        F.when(F.col("event_type") == "click", "NEW").otherwise("RUNNING").alias("status"),
        (F.col("user_id") % 10).alias("priority"),
        F.col("ts").alias("available_utc"),
        F.col("ts").alias("created_utc"),
        (F.col("event_id") % 3).cast("int").alias("attempt_count"),
        F.lit(3).alias("max_attempts"),
        F.when(F.col("event_id") % 2 == 0, "FAILED").otherwise("SUCCEEDED").alias("outcome"),
        F.lit("boom").alias("error"),
    )


_JOBS = """jobs AS (SELECT event_id AS job_id, CASE WHEN event_type = 'click' THEN 'NEW' ELSE 'RUNNING' END AS status, user_id % 10 AS priority, ts AS available_utc, ts AS created_utc,
    CAST(event_id % 3 AS INT) AS attempt_count, 3 AS max_attempts, CASE WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS outcome FROM events)"""


@query(f"""WITH {_JOBS} SELECT job_id, priority, 'RUNNING' AS status, attempt_count + 1 AS attempt_count FROM jobs
    WHERE status = 'NEW' AND available_utc <= TIMESTAMP '2024-01-15 00:00:00' AND attempt_count < max_attempts ORDER BY priority DESC, available_utc, created_utc, job_id LIMIT 20""")
def claim_next(w):
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return queue.claim_next(_jobs(w), now, 20).select("job_id", "priority", "status", "attempt_count")


@query(f"""WITH {_JOBS} SELECT job_id, CASE WHEN outcome = 'FAILED' AND attempt_count < 2 THEN 'NEW' WHEN outcome = 'FAILED' THEN 'DEADLETTER' ELSE outcome END AS status,
    CASE WHEN outcome = 'FAILED' AND attempt_count < 2 THEN TIMESTAMP '2024-02-01 00:00:00' + to_seconds(60 * attempt_count) ELSE available_utc END AS available_utc,
    CASE WHEN outcome = 'FAILED' THEN 'boom' END AS last_error FROM jobs""")
def complete_job(w):
    jobs = _jobs(w).withColumn("max_attempts", F.lit(2))
    return queue.complete(jobs, "outcome", "error", "TIMESTAMP_NTZ '2024-02-01 00:00:00'").select("job_id", "status", "available_utc", "last_error")


@query(f"""WITH {_JOBS}, d AS (SELECT CASE WHEN outcome = 'FAILED' AND attempt_count < 2 THEN 'NEW' WHEN outcome = 'FAILED' THEN 'DEADLETTER' ELSE outcome END AS status, attempt_count FROM jobs)
    SELECT count(*) AS jobs, count_if(status = 'SUCCEEDED') AS succeeded, count_if(status = 'DEADLETTER') AS dead,
    round(count_if(status = 'SUCCEEDED') / count_if(status IN ('SUCCEEDED', 'DEADLETTER')), 6) AS success_rate, round(avg(attempt_count), 6) AS mean_attempts FROM d""")
def run_metrics(w):
    return queue.run_metrics(queue.complete(_jobs(w).withColumn("max_attempts", F.lit(2)), "outcome", "error", "TIMESTAMP_NTZ '2024-02-01 00:00:00'"))


@query("SELECT event_id AS job_id, event_type AS job_type, props AS payload, 'NEW' AS status, CAST(coalesce(CASE WHEN event_id % 3 = 0 THEN event_id % 50 END, 100) AS INT) AS priority, 0 AS attempt_count, 3 AS max_attempts, TIMESTAMP '2024-02-01 00:00:00' AS available_utc, TIMESTAMP '2024-02-01 00:00:00' AS created_utc FROM events")
def enqueue_jobs(w):
    asked = w["events"].select(F.col("event_id").alias("job_id"), F.col("event_type").alias("job_type"), F.col("props").alias("payload"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 50).cast("int")).alias("priority"))
    return queue.new_jobs(asked, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query(f"""WITH {_JOBS} SELECT job_id || ':' || attempt_count AS run_id, job_id, CASE WHEN job_id % 4 = 3 THEN 'RUNNING' ELSE outcome END AS status, TIMESTAMP '2024-02-01 00:00:00' AS started_utc,
    CASE WHEN job_id % 4 <> 3 THEN TIMESTAMP '2024-02-01 00:05:00' END AS completed_utc, CASE WHEN job_id % 4 <> 3 AND outcome = 'FAILED' THEN 'boom' END AS error FROM jobs""")
def run_rows(w):
    start, end = (F.lit(f"2024-02-01 00:0{m}:00").cast("timestamp_ntz") for m in (0, 5))
    jobs = _jobs(w)
    runs = queue.start_runs(jobs, start)
    ended = jobs.where("job_id % 4 <> 3").select(F.concat_ws(":", F.col("job_id").cast("string"), F.col("attempt_count").cast("string")).alias("run_id"), "outcome", F.col("error").alias("message"))
    return queue.end_runs(runs, ended, end)


@query(f"WITH {_JOBS} SELECT job_id, status, priority, attempt_count, created_utc FROM jobs WHERE status = 'NEW' ORDER BY created_utc DESC, job_id LIMIT 20")
def job_listing(w):
    return queue.list_jobs(_jobs(w).withColumn("job_type", F.lit("derive")), 20, "NEW", "derive").select("job_id", "status", "priority", "attempt_count", "created_utc")


@query(f"""WITH {_JOBS} SELECT status, count(*) AS n, min(created_utc) AS oldest, round(avg(attempt_count), 6) AS mean_attempts, count_if(attempt_count >= 2) AS exhausted,
    count_if(status = 'RUNNING' AND available_utc < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 HOUR) AS stuck FROM jobs GROUP BY status""")
def job_inspection(w):
    return queue.inspect_jobs(_jobs(w).withColumn("max_attempts", F.lit(2)), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("SELECT event_id FROM events WHERE event_id % 17 = 0 OR event_id % 19 = 0")
def corrupt_records(w):
    stored = F.when(F.col("event_id") % 19 != 0, F.when(F.col("event_id") % 17 == 0, F.sha2(F.concat("props", F.lit(" ")), 256)).otherwise(F.sha2("props", 256)))
    return snapshot.corrupt(w["events"].withColumn("content_sha256", stored), F.col("props")).select("event_id")


def _sides(w) -> tuple[DataFrame, DataFrame]:
    rows = w["events"].select(
        F.col("event_id").alias("record_id"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.col("event_type"), F.lit("/"), (F.col("user_id") % 40).cast("string"))).alias("natural_key"),
        F.sha2(F.col("props"), 256).alias("content_sha256"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("observed_at"),
    )
    return rows.where("record_id % 2 = 0"), rows.where("record_id % 2 = 1")


_SIDES = """r AS (SELECT event_id AS record_id, CASE WHEN event_id % 11 <> 0 THEN event_type || '/' || CAST(user_id % 40 AS VARCHAR) END AS natural_key, sha256(props) AS content_sha256,
    CASE WHEN event_id % 5 <> 0 THEN ts END AS observed_at FROM events), j AS (SELECT * FROM r WHERE record_id % 2 = 0), s AS (SELECT * FROM r WHERE record_id % 2 = 1),
    m AS (SELECT natural_key, observed_at AS sql_at FROM (SELECT *, row_number() OVER (PARTITION BY natural_key ORDER BY observed_at DESC NULLS LAST, record_id) AS i FROM s WHERE natural_key IS NOT NULL) WHERE i = 1),
    p AS (SELECT j.*, CASE WHEN content_sha256 IN (SELECT content_sha256 FROM s) THEN 'skip' WHEN m.natural_key IS NULL THEN 'insert' WHEN observed_at IS NOT NULL AND sql_at IS NOT NULL THEN
    CASE WHEN observed_at >= sql_at THEN 'update' ELSE 'keep' END WHEN observed_at IS NOT NULL THEN 'update' WHEN sql_at IS NOT NULL THEN 'keep' ELSE 'update' END AS action FROM j LEFT JOIN m USING (natural_key))"""


@query(f"WITH {_SIDES} SELECT record_id, natural_key, content_sha256, observed_at, action FROM p")
def snapshot_conflict_resolution(w):
    return snapshot.import_plan(*_sides(w))


def _sync_sql(dry: bool) -> str:
    left = "s" if dry else "(SELECT content_sha256 FROM s WHERE natural_key IS NULL OR natural_key NOT IN (SELECT natural_key FROM p WHERE action = 'update' AND natural_key IS NOT NULL) UNION ALL SELECT content_sha256 FROM p WHERE action IN ('insert', 'update'))"
    return f"""WITH {_SIDES} SELECT (SELECT count(*) FROM j) AS json_records, (SELECT count(*) FROM s) AS sql_records, count_if(action = 'insert') AS inserted, count_if(action = 'update') AS updated,
        count_if(action = 'keep') AS kept, count_if(action = 'skip') AS skipped, count_if(action = 'failed') AS failed,
        (SELECT count(*) FROM {left} x WHERE content_sha256 NOT IN (SELECT content_sha256 FROM j)) AS exported, {str(dry).upper()} AS dry_run FROM p"""


@query(_sync_sql(False))
def two_way_sync(w):
    return snapshot.sync_report(*_sides(w))


@query(_sync_sql(True))
def dry_run_sync(w):
    return snapshot.sync_report(*_sides(w), dry_run=True)


def _strategy_sql(wins: str) -> str:
    return f"""WITH {_SIDES} SELECT j.record_id, CASE WHEN content_sha256 IN (SELECT content_sha256 FROM s) THEN 'skip' WHEN m.natural_key IS NULL THEN 'insert' ELSE '{wins}' END AS action FROM j LEFT JOIN m USING (natural_key)"""


@query(_strategy_sql("keep"))
def snapshot_prefer_sql(w):
    return snapshot.import_plan(*_sides(w), "prefer_sql").select("record_id", "action")


@query(_strategy_sql("update"))
def snapshot_prefer_json(w):
    return snapshot.import_plan(*_sides(w), "prefer_json").select("record_id", "action")


@query(_strategy_sql("failed"))
def snapshot_fail_on_conflict(w):
    return snapshot.import_plan(*_sides(w), "fail").select("record_id", "action")


@query(f"""WITH {_SIDES} SELECT record_id, natural_key, content_sha256, observed_at FROM s WHERE natural_key IS NULL OR natural_key NOT IN (SELECT natural_key FROM p WHERE action = 'update' AND natural_key IS NOT NULL)
    UNION ALL SELECT record_id, natural_key, content_sha256, observed_at FROM p WHERE action IN ('insert', 'update')""")
def snapshot_import(w):
    json_side, sql_side = _sides(w)
    return snapshot.apply_import(snapshot.import_plan(json_side, sql_side), sql_side)


@query(f"WITH {_SIDES} SELECT action, count(*) AS n FROM p GROUP BY action UNION ALL SELECT 'export', count(*) FROM s WHERE content_sha256 NOT IN (SELECT content_sha256 FROM j)")
def snapshot_report(w):
    json_side, sql_side = _sides(w)
    return snapshot.report(snapshot.import_plan(json_side, sql_side), snapshot.to_export(sql_side, json_side))


@query(f"WITH {_SIDES} SELECT record_id, natural_key, content_sha256, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY observed_at ASC NULLS LAST, record_id) AS i FROM r) WHERE i = 1")
def snapshot_index(w):
    rows = _sides(w)
    every = w["events"].select(
        F.col("event_id").alias("record_id"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.col("event_type"), F.lit("/"), (F.col("user_id") % 40).cast("string"))).alias("natural_key"),
        F.sha2(F.col("props"), 256).alias("content_sha256"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("observed_at"),
    )
    return snapshot.index(every.select(*rows[0].columns))


@query("SELECT n_nationkey, sha256('n_name=' || n_name || '|n_nationkey=' || CAST(n_nationkey AS VARCHAR) || '|n_regionkey=' || CAST(n_regionkey AS VARCHAR)) AS row_hash FROM nation")
def row_hash(w):
    return w["nation"].select("n_nationkey", text.row_hash(w["nation"]).alias("row_hash"))


_GUID = f"""sha1(unhex('{uuid.uuid5(uuid.NAMESPACE_DNS, "dbo.DimWork").hex}') || encode('["' || n_name || '"]'))"""


@query(
    f"""WITH h AS (SELECT *, {_GUID} AS h FROM nation)
    SELECT n_nationkey, n_name, n_regionkey, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || translate(substring(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS WorkGuid,
      sha256('n_name=' || n_name || '|n_nationkey=' || CAST(n_nationkey AS VARCHAR) || '|n_regionkey=' || CAST(n_regionkey AS VARCHAR)) AS RowHash FROM h"""
)
def seed_prepare(w):
    return seeds.prepare(w["nation"], "dbo.DimWork", ["n_name"], "WorkGuid")


@query()
def content_hashes(w):
    e = w["events"]
    none = F.lit(None).cast("string")
    return e.select("event_id", text.content_hash(F.lit("http"), F.lit("sys"), F.col("event_type"), F.col("user_id").cast("string"), none, F.col("props")).alias("content_sha256"))


@query("SELECT c_mktsegment, count(*) AS copies FROM customer GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(w):
    return seeds.duplicates(w["customer"], "c_mktsegment")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0)")
def rows_without_guid(w):
    rows = w["orders"].select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.lit("g")).alias("guid"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("k1"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("k2"))
    return seeds.without_guid(rows, "guid", ["k1", "k2"]).select("o_orderkey")


@query("""WITH n AS (SELECT * FROM nation WHERE n_regionkey <> 2), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
    SELECT 'region' AS table_name, (SELECT count(*) FROM region WHERE r_regionkey <> 2) AS loaded, 0::BIGINT AS refused UNION ALL SELECT 'nation', (SELECT count(*) FROM n), (SELECT count(*) FROM nation) - (SELECT count(*) FROM n)
    UNION ALL SELECT 'customer', (SELECT count(*) FROM c), (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o)""")
def load_in_key_order(w):
    """Nations of a region that isn't there are refused, and so are their customers, and those customers' orders."""
    tables = {"orders": w["orders"], "customer": w["customer"], "nation": w["nation"], "region": w["region"].where("r_regionkey <> 2")}
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}
    found = seeds.load(tables, keys, {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "orders": {"o_custkey": "customer"}})
    out = None
    for name, (good, bad) in found.items():
        row = good.agg(F.count(F.lit(1)).alias("loaded")).crossJoin(bad.agg(F.count(F.lit(1)).alias("refused"))).select(F.lit(name).alias("table_name"), "loaded", "refused")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orders_without_lines(w):
    return seeds.orphans(w["orders"].select("o_orderkey", "o_custkey"), "o_orderkey", w["lineitem"], "l_orderkey")


def _sql_redact(x: str) -> str:
    for _, pattern, marker in text.TEXT_RULES:
        x = f"regexp_replace({x}, '{pattern}', '{marker}', 'gi')"
    return x


@query(f"SELECT doc_id, {_sql_redact('text')} AS redacted FROM documents")
def redact_documents(w):
    return w["documents"].select("doc_id", text.redact(F.col("text")).alias("redacted"))


def _counts_sql() -> str:
    x, out = "text", []
    for name, pattern, marker in text.TEXT_RULES:
        out.append(f"CAST(sum(len(regexp_extract_all({x}, '{pattern}', 0, 'i'))) AS BIGINT) AS {name}")
        x = f"regexp_replace({x}, '{pattern}', '{marker}', 'gi')"
    return f"SELECT {', '.join(out)} FROM documents"


@query(_counts_sql())
def redaction_counts(w):
    return w["documents"].select(*(F.sum(c).alias(n) for n, c in text.redaction_counts(F.col("text")).items()))


def _offsets_sql() -> str:
    """For each document and rule, the matches and the sum of their first and last offsets."""
    x, out = "text", []
    for name, pattern, marker in text.TEXT_RULES:
        m, p = f"regexp_extract_all({x}, '{pattern}', 0, 'i')", f"regexp_split_to_array({x}, '{pattern}', 'i')"
        out.append(f"SELECT doc_id, '{name}' AS rule, {m} AS m, {p} AS p FROM documents")
        x = f"regexp_replace({x}, '{pattern}', '{marker}', 'gi')"
    size = lambda a: f"coalesce(list_sum(list_transform({a}, lambda y: length(y))), 0)"
    begin, end = f"{size('p[1:1]')}", f"{size('p[1:len(m)]')} + {size('m')}"
    return f"SELECT doc_id, rule, CAST(len(m) AS BIGINT) AS n, CAST({begin} AS INT) AS first_start, CAST({end} AS INT) AS last_end FROM ({' UNION ALL '.join(out)}) WHERE len(m) > 0"


@query(_offsets_sql())
def redaction_offsets(w):
    rows = w["documents"].select("doc_id", F.explode(text.redaction_offsets(F.col("text"))).alias("o"))
    return rows.groupBy("doc_id", "o.rule").agg(F.count(F.lit(1)).alias("n"), F.min("o.start").alias("first_start"), F.max("o.end").alias("last_end"))


@query(rf"SELECT page_id, regexp_replace(url || '&token=abc' || CAST(page_id AS VARCHAR), '([?&])({'|'.join(text.SECRET_PARAMETERS)})=([^&\s]+)', '\1\2=[REDACTED]', 'gi') AS url FROM pages")
def redact_urls(w):
    return w["pages"].select("page_id", text.redact_url(F.concat("url", F.lit("&token=abc"), F.col("page_id").cast("string"))).alias("url"))


@query(
    """WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents),
    c AS (SELECT doc_id, CASE WHEN n <= 200 THEN n WHEN substring(h, 401, 1) IN ('8', '9', 'A', 'B') THEN 197 ELSE 200 END AS k, n, h FROM b),
    d AS (SELECT doc_id, h, CASE WHEN n <= 200 OR k = 200 THEN k WHEN substring(h, 395, 1) NOT IN ('8', '9', 'A', 'B') THEN 197 WHEN substring(h, 393, 1) NOT IN ('8', '9', 'A', 'B') THEN 196
    WHEN substring(h, 391, 1) NOT IN ('8', '9', 'A', 'B') THEN 195 ELSE 194 END AS k FROM c)
    SELECT doc_id, CAST(k AS BIGINT) AS whole_bytes, sha256(unhex(substring(h, 1, 2 * k))) AS cut_sha256 FROM d"""
)
def truncate_texts(w):
    cut = text.truncate_bytes(F.col("text"), 200)
    return w["documents"].select("doc_id", F.octet_length(cut).cast("long").alias("whole_bytes"), F.sha2(cut, 256).alias("cut_sha256"))


_SAMPLED = """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_orderkey, o_custkey FROM r WHERE n <= 4 OR """


@query(_SAMPLED + "i <= 2 OR i > n - 2")
def sample_first_last(w):
    return evidence.sample_rows(w["orders"], "o_custkey", ["o_orderdate", "o_orderkey"], 4, "first_last").select("o_orderkey", "o_custkey")


@query(_SAMPLED + "((i - 1) % greatest(n // 4, 1) = 0 AND (i - 1) < greatest(n // 4, 1) * 4)")
def sample_stride(w):
    return evidence.sample_rows(w["orders"], "o_custkey", ["o_orderdate", "o_orderkey"], 4, "stride").select("o_orderkey", "o_custkey")


@query(
    """WITH RECURSIVE t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    f(conv_id, i, used, ids) AS (SELECT conv_id, 0, 0, CAST([] AS BIGINT[]) FROM (SELECT DISTINCT conv_id FROM t)
    UNION ALL SELECT f.conv_id, t.i, CASE WHEN used + n <= 1500 THEN used + n ELSE used END, CASE WHEN used + n <= 1500 THEN list_append(ids, turn) ELSE ids END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1 WHERE t.i <= 6)
    SELECT conv_id, array_to_string(arg_max(ids, i), ',') AS ids, CAST(arg_max(used, i) AS BIGINT) AS bytes FROM f GROUP BY conv_id"""
)
def bundle_bounding(w):
    items = w["conversations"].select("conv_id", "turn", F.col("turn").alias("item_id"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    found = evidence.bound_bundles(items, "conv_id", ["turn"], "n", max_items=6, max_bytes=1500)
    return found.select("conv_id", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), "bytes")


@query(
    """SELECT CASE doc_id % 3 WHEN 0 THEN 'doc_chunk' WHEN 1 THEN 'lake_text' ELSE 'inline_text' END AS evidence_type, count(*) AS items,
    CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(floor(sum(octet_length(encode(text))) / 4) AS BIGINT) AS tokens FROM documents GROUP BY 1"""
)
def evidence_summary(w):
    kind = F.when(F.col("doc_id") % 3 == 0, "doc_chunk").when(F.col("doc_id") % 3 == 1, "lake_text").otherwise("inline_text")
    return evidence.summary(w["documents"].select(kind.alias("evidence_type"), F.octet_length("text").alias("byte_count")))


@query(
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'doc:' || left(sha256(source), 12) || ':' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'lake:' || left(sha256(source), 12) || ':' || CAST(doc_id AS VARCHAR)
    ELSE 'inline:' || CAST(doc_id AS VARCHAR) END AS evidence_id FROM documents"""
)
def evidence_ids(w):
    kind = F.when(F.col("doc_id") % 3 == 0, "doc_chunk").when(F.col("doc_id") % 3 == 1, "lake_text").otherwise("inline_text")
    return w["documents"].select("doc_id", text.evidence_id(kind, F.col("source"), F.col("doc_id")).alias("evidence_id"))


def _cut_sql(x: str, most: int) -> str:
    """SQL for x within most bytes; where that cuts a character, three more bytes go, and then those of a cut character."""
    digits, at = f"hex(encode({x}))", lambda k: f"substring(hex(encode({x})), {2 * k + 1}, 1) IN ('8', '9', 'A', 'B')"
    size = f"CASE WHEN NOT {at(most)} THEN {most} " + " ".join(f"WHEN NOT {at(most - k)} THEN {most - k}" for k in (3, 4, 5)) + f" ELSE {most - 6} END"
    return f"CASE WHEN octet_length(encode({x})) <= {most} THEN {x} ELSE decode(unhex(substring({digits}, 1, 2 * ({size})))) END"


@query(
    f"""WITH d AS (SELECT source AS bundle, doc_id AS source_ordinal, CASE doc_id % 3 WHEN 0 THEN 'doc_chunk' WHEN 1 THEN 'lake_http' ELSE 'sql_query_def' END AS evidence_type, left(sha256(lang), 12) AS ref,
    coalesce(text, '') AS raw FROM documents), r AS (SELECT *, CASE evidence_type WHEN 'doc_chunk' THEN {_sql_redact('raw')} ELSE raw END AS x FROM d), c AS (SELECT *, {_cut_sql('x', 1000)} AS y FROM r),
    o AS (SELECT *, CASE evidence_type WHEN 'lake_http' THEN {_sql_redact('y')} ELSE y END AS content FROM c)
    SELECT bundle, source_ordinal, evidence_type, CASE evidence_type WHEN 'doc_chunk' THEN 'doc:' || ref || ':' || source_ordinal WHEN 'lake_http' THEN 'lake:' || ref || ':' || source_ordinal ELSE 'sqldef:' || ref END AS item_id,
    sha256(content) AS content_sha256, octet_length(encode(content)) AS byte_count, octet_length(encode(raw)) > 1000 AS cut FROM o"""
)
def evidence_items(w):
    kind = F.when(F.col("doc_id") % 3 == 0, "doc_chunk").when(F.col("doc_id") % 3 == 1, "lake_http").otherwise("sql_query_def")
    rows = w["documents"].select(F.col("source").alias("bundle"), F.col("doc_id").alias("source_ordinal"), kind.alias("evidence_type"), F.col("lang").alias("source_ref"), "text")
    return evidence.load_items(rows, 1000).drop("content")


_CHUNKS = """s AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) <= 2000 THEN 1 ELSE 1 + CAST(ceil((length(text) - 2000) / 1800.0) AS INT) END AS c FROM documents WHERE length(text) > 0),
    x AS (SELECT doc_id, text, n, unnest(range(0, c)) AS i FROM s), y AS (SELECT *, substring(text, CAST(i * 1800 + 1 AS BIGINT), 2000) AS w FROM x),
    z AS (SELECT *, CASE WHEN i * 1800 + 2000 < n AND contains(w, ' ') AND length(w) - strpos(reverse(w), ' ') > 1000 THEN i * 1800 + length(w) - strpos(reverse(w), ' ') ELSE least(i * 1800 + 2000, n) END AS e FROM y)"""


@query(
    f"""WITH {_CHUNKS} SELECT sha256(CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR) || ':' || CAST(i * 1800 AS VARCHAR) || ':' || CAST(e AS VARCHAR) || ':1.0') AS chunk_id, doc_id AS source_id,
    CAST(i AS INT) AS chunk_index, CAST(i * 1800 AS INT) AS start_offset, CAST(e AS INT) AS end_offset, sha256(substring(text, CAST(i * 1800 + 1 AS BIGINT), CAST(e - i * 1800 AS BIGINT))) AS content_sha256 FROM z"""
)
def chunk_documents(w):
    rows = retrieval.chunk_records(w["documents"].select(F.col("doc_id").alias("source_id"), F.col("text").alias("content")), most=None)
    return rows.select("chunk_id", "source_id", F.col("chunk_index").cast("int"), F.col("start_offset").cast("int"), F.col("end_offset").cast("int"), "content_sha256")


@query("SELECT doc_id AS source_id, sha256(text) AS content_sha256 FROM documents WHERE doc_id % 10 < 3 OR doc_id % 10 >= 8")
def incremental_index(w):
    docs = w["documents"].select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"))
    old = docs.where("source_id % 10 < 8").select("source_id", F.when(F.col("source_id") % 10 < 3, F.lit("stale")).otherwise(F.sha2("content", 256)).alias("content_sha256"))
    return retrieval.to_index(docs, old).select("source_id", "content_sha256")


@query(
    f"""WITH {_CHUNKS}, c AS (SELECT substring(text, CAST(i * 1800 + 1 AS BIGINT), CAST(e - i * 1800 AS BIGINT)) AS t FROM z WHERE doc_id % 10 < 3 OR doc_id % 10 >= 8),
    n AS (SELECT (SELECT count(*) FROM documents) AS sources, (SELECT count(*) FROM documents WHERE doc_id % 10 < 3 OR doc_id % 10 >= 8) AS indexed)
    SELECT sources, indexed, (SELECT count(*) FROM c) AS chunks, CAST((SELECT sum(octet_length(encode(t))) FROM c) AS BIGINT) AS bytes, sources - indexed AS skipped FROM n"""
)
def index_run(w):
    docs = w["documents"].select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"))
    old = docs.where("source_id % 10 < 8").select("source_id", F.when(F.col("source_id") % 10 < 3, F.lit("stale")).otherwise(F.sha2("content", 256)).alias("content_sha256"))
    fresh = retrieval.to_index(docs, old)
    return retrieval.index_manifest(docs, fresh, retrieval.chunk_records(fresh, most=None))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s WHERE score >= 0) SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""
)
def cosine_topk(w):
    v = w["embeddings"].select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    queries = v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return retrieval.top_k(queries, v, 5).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query()
def vector_hashes(w):
    return w["embeddings"].select("vec_id", text.vector_hash("embedding").alias("vector_sha256"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM labels) AS labelled, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unlabelled, round(100.0 * (SELECT count(*) FROM labels) / nullif((SELECT count(*) FROM documents), 0), 6)::DOUBLE AS percent")
def label_coverage(w):
    docs, labels = w["documents"], w["labels"]
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    row = one(docs, "documents").crossJoin(one(labels, "labelled")).crossJoin(one(docs.join(labels, "doc_id", "left_anti"), "unlabelled"))
    return row.withColumn("percent", F.round(F.col("labelled") * 100.0 / F.nullif(F.col("documents"), F.lit(0)), 6))


@query("SELECT sha256(text) AS content_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedupe_by_hash(w):
    return w["documents"].groupBy(F.sha2("text", 256).alias("content_sha256")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(
    """WITH f AS (SELECT o_orderkey + 250 AS o_orderkey, o_custkey, 'X' AS o_orderstatus FROM orders WHERE o_orderstatus = 'F')
    SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ANTI JOIN f USING (o_orderkey) UNION ALL SELECT * FROM f"""
)
def upsert_orders(w):
    rows = w["orders"].select("o_orderkey", "o_custkey", "o_orderstatus")
    fresh = rows.where("o_orderstatus = 'F'").select((F.col("o_orderkey") + 250).alias("o_orderkey"), "o_custkey", F.lit("X").alias("o_orderstatus"))
    return snapshot.upsert(rows, fresh, "o_orderkey")


@query(
    """WITH RECURSIVE c AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS node, 'n' || CAST(s_nationkey AS VARCHAR) AS parent FROM supplier UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation
    UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), NULL FROM region), r(node, ancestor, distance) AS (SELECT node, node, 0 FROM c UNION ALL SELECT r.node, c.parent, distance + 1 FROM r JOIN c ON c.node = r.ancestor WHERE c.parent IS NOT NULL)
    SELECT ancestor, count(*) AS members, max(distance) AS depth FROM r GROUP BY ancestor"""
)
def hierarchy_rollup(w):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = w["supplier"].select(key("s", "s_suppkey").alias("node"), key("n", "s_nationkey").alias("parent"))
    rows = rows.unionByName(w["nation"].select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent")))
    rows = rows.unionByName(w["region"].select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent")))
    return graph.closure(rows).groupBy("ancestor").agg(F.count(F.lit(1)).alias("members"), F.max("distance").alias("depth"))


@query("SELECT event_id, user_id, count(*) OVER w AS seen, event_id - lag(event_id) OVER w AS gap, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS value_rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def event_windows(w):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rank = F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value"))).cast("long")
    return w["events"].select("event_id", "user_id", F.count(F.lit(1)).over(by).alias("seen"), (F.col("event_id") - F.lag("event_id").over(by)).alias("gap"), rank.alias("value_rank"))


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def daily_counts(w):
    end = F.lit("1998-01-01").cast("date")
    day = F.to_date("o_orderdate")
    return w["orders"].where((day >= F.date_sub(end, 365)) & (day < end)).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_paths(w):
    return w["events"].groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("(SELECT o_custkey AS c FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0) EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def set_operations(w):
    rich = w["customer"].where("c_acctbal > 0").select("c_custkey")
    return w["orders"].select(F.col("o_custkey").alias("c")).intersect(rich).exceptAll(w["customer"].where("c_nationkey = 3").select("c_custkey"))


@query("SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def segment_rollup(w):
    return w["customer"].join(F.broadcast(w["nation"]), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in BASE))
def table_counts(w):
    found = [w[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in BASE]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@query("SELECT url, 'https://wiki.example/api.php?action=query&format=json&titles=' || replace(replace(source, ' ', '+'), '/', '%2F') || '&prop=links&pllimit=500' AS request FROM (SELECT 'doc ' || source || '/' || lang AS source, CAST(doc_id AS VARCHAR) AS url FROM documents)")
def request_addresses(w):
    name = F.concat(F.lit("doc "), F.col("source"), F.lit("/"), F.col("lang"))
    return w["documents"].select(F.col("doc_id").cast("string").alias("url"), ingest.wiki_links("https://wiki.example/api.php", name).alias("request"))


@query("SELECT role AS artifact_type, count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes, min(sha256(coalesce(text, ''))) AS first_hash FROM conversations GROUP BY 1")
def artifact_bytes(w):
    rows = ingest.artifacts(w["conversations"].withColumn("text", F.coalesce("text", F.lit(""))), "text")
    return rows.groupBy(F.col("role").alias("artifact_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("byte_count").alias("bytes"), F.min("content_sha256").alias("first_hash"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def argmax_with_ties(w):
    return relational.most_of_group(w["orders"].select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice")


@query("SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 9) AS percent FROM orders GROUP BY 1")
def share_of_total(w):
    return relational.share_of_total(w["orders"], "o_orderstatus")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY 1 LIMIT 3")
def guarded_select(w):
    return ingest.run_select(w.spark, "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_totalprice > 100000 GROUP BY 1 ORDER BY 1", 3, orders=w["orders"])


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_events(w):
    """The batch answer of the streaming count by hour."""
    return w["events"].groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly count, run as a stream to the end of what is there; each batch's result replaces the file before."""
    from narrata.streaming import events

    stream = events.hourly(events.read(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema))
    at = scratch(spark, "hourly")
    stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/counts")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/counts").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | {"streaming_hourly_events": streamed}


def oracle_sql() -> dict[str, str]:
    return SQL | {"streaming_hourly_events": SQL["hourly_events"]}

