"""Queries over the shop's tables: histories, as-of and interval joins, schedules; each with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions import documents
from narrata.functions.times import DAY, SECOND, micros, stamp
from narrata.operators import evidence, grams, history, intervals, observed, ordered, sampling, sketches
from narrata.plans.corpus import query
from narrata.sources import snapshot_source
from narrata.sources.shared import scratch
from narrata.streaming import runloop

_ATTRIBUTES = ["source", "segment", "city", "balance"]
_CHAIN = ["client_id", *_ATTRIBUTES, "ValidFromUtc", "ValidToUtc", "VersionNum", "IsActive", "IsLatest"]


def _chain(rows: str, tie: str, v: str = "v") -> str:
    """CTEs that end in v, the version chains of rows (client_id, valid_at, attributes, gone)."""
    same = " AND ".join(f"{c} IS NOT DISTINCT FROM lag({c}) OVER w" for c in (*_ATTRIBUTES, "gone"))
    return f"""{v}_one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, valid_at ORDER BY {tie}) AS i FROM {rows}
        WHERE client_id IS NOT NULL AND valid_at IS NOT NULL) WHERE i = 1),
    {v}_same AS (SELECT *, lag(client_id) OVER w IS NOT NULL AND {same} AS same FROM {v}_one WINDOW w AS (PARTITION BY client_id ORDER BY valid_at)),
    {v} AS (SELECT client_id, {", ".join(_ATTRIBUTES)}, valid_at AS ValidFromUtc, lead(valid_at) OVER w AS ValidToUtc, row_number() OVER w AS VersionNum, NOT gone AS IsActive,
        lead(valid_at) OVER w IS NULL AS IsLatest FROM {v}_same WHERE NOT same WINDOW w AS (PARTITION BY client_id ORDER BY valid_at))"""


_CHANGES = f"c AS (SELECT client_id, valid_at, seq, change_id, coalesce(op = 'D', FALSE) AS gone, {', '.join(_ATTRIBUTES)} FROM client_changes)"
_TIE = "seq DESC NULLS LAST, change_id DESC NULLS LAST"


def _versions(w, rows: DataFrame | None = None) -> DataFrame:
    return history.versions(w["client_changes"] if rows is None else rows, ["client_id"], "valid_at", ["seq", "change_id"], _ATTRIBUTES, F.col("op") == "D")


@query(f"WITH {_CHANGES}, {_chain('c', _TIE)} SELECT {', '.join(_CHAIN)} FROM v")
def client_versions(w):
    """The version chains of all clients."""
    return _versions(w).select(*_CHAIN)


@query(
    f"""WITH {_CHANGES}, {_chain("(SELECT * FROM c WHERE change_id % 3 <> 0)", _TIE, "v1")},
    k AS (SELECT DISTINCT client_id FROM c WHERE change_id % 3 = 0 AND valid_at IS NOT NULL),
    both_ AS (SELECT client_id, ValidFromUtc AS valid_at, 0 AS late, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS change_id, NOT IsActive AS gone, {", ".join(_ATTRIBUTES)} FROM v1 SEMI JOIN k USING (client_id)
      UNION ALL SELECT client_id, valid_at, 1, seq, change_id, gone, {", ".join(_ATTRIBUTES)} FROM c WHERE change_id % 3 = 0), {_chain("both_", "late DESC, " + _TIE)}
    SELECT {", ".join(f"v.{c}" for c in _CHAIN)}, CASE WHEN v1.client_id IS NULL THEN 'opened' WHEN v1.ValidToUtc IS NOT DISTINCT FROM v.ValidToUtc THEN 'left' ELSE 'closed' END AS action
    FROM v LEFT JOIN v1 ON v.client_id = v1.client_id AND v.ValidFromUtc = v1.ValidFromUtc AND v.IsActive = v1.IsActive AND {" AND ".join(f"v.{c} IS NOT DISTINCT FROM v1.{c}" for c in _ATTRIBUTES)}
    UNION ALL SELECT {", ".join(_CHAIN)}, 'left' FROM v1 ANTI JOIN k USING (client_id)"""
)
def client_versions_merged(w):
    """A load of every third change, most of them late, into the history of the others."""
    changes = w["client_changes"]
    before = _versions(w, changes.where("change_id % 3 <> 0"))
    merged = history.merge(before, changes.where("change_id % 3 = 0"), ["client_id"], "valid_at", ["seq", "change_id"], _ATTRIBUTES, F.col("op") == "D")
    return merged.select(*_CHAIN, "action")


@query(f"""WITH {_CHANGES}, {_chain("c", _TIE)} SELECT VersionNum, count(*) AS n, count(*) FILTER (WHERE IsLatest) AS latest, count(*) FILTER (WHERE IsActive) AS active FROM v GROUP BY VersionNum""")
def version_depths(w):
    """How many clients have so many versions, and which of those are the latest and active."""
    return _versions(w).groupBy("VersionNum").agg(F.count(F.lit(1)).alias("n"), F.count_if("IsLatest").alias("latest"), F.count_if("IsActive").alias("active"))


@query(
    f"""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, valid_at ORDER BY {_TIE}) AS i FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL) WHERE i = 1)
    SELECT s.sale_id, s.client_id, s.sold_at, s.total, c.seq, c.op, c.segment, c.city FROM sales s ASOF LEFT JOIN c ON s.client_id = c.client_id AND s.sold_at >= c.valid_at"""
)
def sale_client_state(w):
    """Each sale with its client's last change at or before it."""
    sales = w["sales"].select("sale_id", "client_id", "sold_at", "total")
    return ordered.as_of(sales, w["client_changes"], ["client_id"], "sold_at", "valid_at", ["seq", "op", "segment", "city"], ["seq", "change_id"])


@query(
    f"""WITH {_CHANGES}, {_chain("c", _TIE)},
    s AS (SELECT sale_id, client_id, min(epoch_us(sold_at)) AS us, max(epoch_us(shipped_at)) AS until FROM sales JOIN sale_lines USING (sale_id) GROUP BY ALL)
    SELECT sale_id, client_id, us, until, VersionNum, segment FROM s JOIN v USING (client_id) WHERE until > us AND epoch_us(ValidFromUtc) < until AND (ValidToUtc IS NULL OR epoch_us(ValidToUtc) > us)"""
)
def sale_client_versions(w):
    """The versions of its client that hold while a sale is open, from its time to its last shipment."""
    shipped = w["sale_lines"].groupBy("sale_id").agg(F.max(micros("shipped_at")).alias("end"))
    sales = w["sales"].where("sale_id IS NOT NULL").groupBy("sale_id", "client_id").agg(F.min(micros("sold_at")).alias("start"))
    chains = _versions(w).select("client_id", micros("ValidFromUtc").alias("start"), micros("ValidToUtc").alias("end"), "VersionNum", "segment")
    pairs = intervals.overlaps(sales.join(shipped, "sale_id").where("end IS NOT NULL"), chains, ["client_id"], "start", "end", 7 * DAY)
    return pairs.select("sale_id", "client_id", F.col("start").alias("us"), F.col("end").alias("until"), F.col("VersionNum_right").alias("VersionNum"), F.col("segment_right").alias("segment"))


def _looks(w) -> DataFrame:
    scenes = w["DimScene"].select("SceneKey", "WorkKey", "StartSec", "EndSec")
    return w["DimAppearanceLook"].select("LookKey", "CharacterKey", "WorkKey", "SceneKey").join(scenes, ["SceneKey", "WorkKey"])


@query(
    """WITH l AS (SELECT o_orderkey AS LookKey, o_custkey AS CharacterKey, c_nationkey AS WorkKey, CAST(o_orderkey % 60 * 120 AS INT) AS StartSec, CAST(o_orderkey % 60 * 120 + o_orderkey % 240 AS INT) AS EndSec
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 4 = 1)
    SELECT a.WorkKey, a.CharacterKey, a.LookKey, b.LookKey AS OtherKey, greatest(a.StartSec, b.StartSec) AS FromSec, least(a.EndSec, b.EndSec) AS ToSec
    FROM l a JOIN l b ON a.CharacterKey = b.CharacterKey AND a.WorkKey = b.WorkKey AND a.LookKey < b.LookKey AND a.StartSec < b.EndSec AND b.StartSec < a.EndSec"""
)
def look_conflicts(w):
    """Looks of one character in one work whose scenes run at the same seconds."""
    looks = _looks(w)
    pairs = intervals.overlaps(looks, looks, ["WorkKey", "CharacterKey"], "StartSec", "EndSec", 600)
    return pairs.where("LookKey < LookKey_right").select(
        "WorkKey", "CharacterKey", "LookKey", F.col("LookKey_right").alias("OtherKey"), F.greatest("StartSec", "StartSec_right").alias("FromSec"), F.least("EndSec", "EndSec_right").alias("ToSec")
    )


@query(
    f"""WITH r AS (SELECT click_id, client_id, epoch_us(ts) AS us FROM (SELECT click_id, client_id, min(ts) AS ts FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL AND kind = 'error' GROUP BY ALL)),
    a AS (SELECT click_id, client_id, k AS attempt, us + {60 * SECOND} * ((1 << k) - 1) AS us FROM r, (SELECT unnest(range(4)) AS k)),
    i AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY us, click_id, attempt) - 1 AS i FROM a)
    SELECT click_id, client_id, CAST(attempt AS INT) AS attempt, make_timestamp(CAST(max(us - i * {30 * SECOND}) OVER (PARTITION BY client_id ORDER BY i) + i * {30 * SECOND} AS BIGINT)) AS starts_at FROM i"""
)
def fetch_schedule(w):
    """Attempts at what failed, spaced 1, 2 and 4 minutes apart, no two of one client within 30 seconds."""
    failed = w["clicks"].where("ts IS NOT NULL AND client_id IS NOT NULL AND kind = 'error'").groupBy("click_id", "client_id").agg(F.min("ts").alias("ts"))
    tries = failed.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("us", micros("ts") + 60 * SECOND * (F.pow(F.lit(2), F.col("attempt")).cast("long") - 1))
    found = ordered.spaced(tries, ["client_id"], "us", ["click_id", "attempt"], 30 * SECOND)
    return found.select("click_id", "client_id", "attempt", stamp(F.col("start_us")).alias("starts_at"))


@query(
    """WITH n AS (SELECT DISTINCT lower(name) AS name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT p_name FROM part UNION ALL SELECT text FROM benchmark UNION ALL SELECT city FROM clients) WHERE name <> '')
    SELECT name, doc_id FROM n JOIN (SELECT DISTINCT doc_id, lower(text) AS text FROM documents) d ON contains(text, name)"""
)
def name_mentions(w):
    """Documents and the names (nations, parts, cities, benchmark items) that their whole texts have, inside words too."""
    texts = w["documents"].select(F.col("doc_id").alias("text_id"), F.lower("text").alias("text"))
    names = w["nation"].select(F.lower("n_name").alias("name")).union(w["part"].select(F.lower("p_name"))).union(w["benchmark"].select(F.lower("text"))).union(w["clients"].select(F.lower("city")))
    return grams.containing(texts, names).select("name", F.col("text_id").alias("doc_id"))


@query()
def fetch_loop(w):
    """A client's clicks of an hour as requests for one item and as results of its fetches, in four batches by arrival."""
    hour = F.date_format("arrived_at", "yyyy-MM-dd HH")
    clicks = w["clicks"].where("click_id IS NOT NULL AND client_id IS NOT NULL AND arrived_at IS NOT NULL").dropDuplicates(["click_id"])
    rows = clicks.select(
        F.concat_ws(":", F.col("client_id").cast("string"), hour).alias("item"),
        F.col("arrived_at").alias("at"),
        F.col("click_id").alias("seq"),
        F.when(F.col("kind") == "error", 503).when(F.col("kind").isin("click", "purchase"), 200).cast("int").alias("status_code"),
        F.least(F.lit(3), F.greatest(F.lit(0), F.month("arrived_at") - 1)).alias("batch"),
    )
    return runloop.replay(rows, 4)


@query(
    """WITH c AS (SELECT click_id, props, coalesce(json_valid(props), FALSE) AS ok FROM clicks), j AS (SELECT *, CASE WHEN ok THEN CAST(props AS JSON) END AS x FROM c)
    SELECT click_id, TRY_CAST(json_extract_string(x, '$.k') AS INT) AS k, json_extract_string(x, '$.device.os') AS os, json_extract_string(x, '$.device.ver') AS ver,
      CASE WHEN json_type(x, '$.tags') = 'ARRAY' THEN CAST(json_array_length(x, '$.tags') AS INT) END AS n_tags,
      CASE WHEN json_type(x, '$.items') = 'ARRAY' THEN coalesce(CAST(list_sum(CAST(json_extract(x, '$.items[*].qty') AS BIGINT[])) AS BIGINT), 0) END AS quantity,
      CASE WHEN props IS NULL THEN 'missing' WHEN NOT ok THEN 'broken' END AS props_fault FROM j"""
)
def click_attributes(w):
    """What the clicks' JSON says, by typed paths."""
    paths = {"k": ("$.k", "int"), "os": ("$.device.os", "string"), "ver": ("$.device.ver", "string"), "_tags": ("$.tags", "array<variant>"), "_items": ("$.items", "array<struct<sku:long,qty:long>>")}
    found = documents.attributes(w["clicks"].select("click_id", "props"), "props", paths)
    quantity = F.aggregate("_items", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["qty"], F.lit(0)))
    n_tags = F.when(F.col("_tags").isNotNull(), F.size("_tags"))
    return found.select("click_id", "k", "os", "ver", n_tags.alias("n_tags"), quantity.alias("quantity"), "props_fault")


@query()
def props_shape(w):
    """The schema that the JSON of each kind of click has together."""
    return documents.shape(w["clicks"], "props", "kind")


@query(
    r"""WITH l AS (SELECT click_id, props, CASE WHEN json_valid(props) THEN array_to_string(list_transform(string_split(json_pretty(CAST(props AS JSON)), chr(10)),
      lambda l: repeat(' ', (length(l) - length(ltrim(l))) // 2) || ltrim(l)), chr(10)) END AS t FROM clicks),
    p AS (SELECT click_id, coalesce(array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN unicode(c) > 127 THEN '\u' || printf('%04x', unicode(c)) ELSE c END), ''), props) AS t FROM l)
    SELECT click_id, length(t) AS n_chars, left(t, 60) AS begins FROM p"""
)
def json_texts(w):
    """The clicks' JSON laid out for reading, cut at 60 bytes."""
    rows = w["clicks"].select("click_id", "props", documents.readable("props").alias("t"))
    return rows.select("click_id", F.length("t").cast("long").alias("n_chars"), documents.truncate_bytes(F.col("t"), 60).alias("begins"))


@query(
    """SELECT coalesce(kind, 'none') AS kind, count(*) AS n, count(DISTINCT client_id) AS n_clients, TRUE AS clients_near, TRUE AS median_near, TRUE AS top_near
    FROM clicks GROUP BY 1"""
)
def sketch_accuracy(w):
    """Sketches of each day and kind, merged by kind, and whether their estimates are within the bounds of the exact figures.

    Distinct clients within 5 percent and 2; the median's rank within 5 percent; the most frequent client is
    the sketch's first, with its very count.
    """
    clicks = w["clicks"].select(F.coalesce("kind", F.lit("none")).alias("kind"), F.to_date("arrived_at").alias("day"), "client_id", "value")
    daily = sketches.sketched(clicks, ["day", "kind"], "client_id", "value")
    found = sketches.merged(daily, ["kind"], [0.5])
    exact = clicks.groupBy("kind").agg(F.count_distinct("client_id").alias("n_clients"))
    ranks = clicks.where("value IS NOT NULL").join(F.broadcast(found.select("kind", "q_50")), "kind").groupBy("kind").agg(F.avg((F.col("value") <= F.col("q_50")).cast("double")).alias("rank"))
    most = clicks.where("client_id IS NOT NULL").groupBy("kind", "client_id").agg(F.count(F.lit(1)).alias("c")).groupBy("kind").agg(F.max("c").alias("most"))
    return found.join(exact, "kind").join(ranks, "kind").join(most, "kind").select(
        "kind", "n", "n_clients",
        (F.abs(F.col("n_items") - F.col("n_clients")) <= 0.05 * F.col("n_clients") + 2).alias("clients_near"),
        (F.abs(F.col("rank") - 0.5) <= 0.05).alias("median_near"),
        (F.col("top")[0]["count"] == F.col("most")).alias("top_near"),
    )


@query(
    """SELECT sale_id, status, total FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY md5(concat_ws(chr(1), 'a', CAST(sale_id AS VARCHAR)))) AS i FROM sales) WHERE i <= 50"""
)
def stratified_sales(w):
    """Fifty sales of each status."""
    return sampling.bottom_k(w["sales"], ["status"], ["sale_id"], 50, "a").select("sale_id", "status", "total")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE status = 'done') AS done, CAST(sum(CAST(round(total * 100) AS BIGINT)) AS BIGINT) AS cents, max(sold_at) AS newest FROM sales")
def observed_metrics(w):
    """Figures of a run that come from the job that writes its rows."""
    cents = F.sum(F.round(F.col("total") * 100).cast("long"))
    found = observed.written(w["sales"], scratch(w.spark, "sales"), {"n": F.count(F.lit(1)), "done": F.count_if(F.col("status") == "done"), "cents": cents, "newest": F.max("sold_at")})
    return w.spark.createDataFrame([tuple(found[c] for c in ("n", "done", "cents", "newest"))], "n long, done long, cents long, newest timestamp_ntz")


@query(
    """WITH o AS (SELECT item_id, '{"sale_id": ' || to_json(sale_id) || ', "line_no": ' || to_json(line_no) || ', "quantity": ' || coalesce(to_json(quantity), 'null') || ', "flag": ' || coalesce(to_json(flag), 'null') || '}' AS line,
      row_number() OVER (PARTITION BY item_id ORDER BY sale_id NULLS FIRST, line_no NULLS FIRST, quantity NULLS FIRST, flag NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY item_id) AS n FROM sale_lines WHERE item_id IS NOT NULL AND sale_id IS NOT NULL AND line_no IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS pos FROM o WHERE n <= 12 OR (i % greatest(n // 12, 1) = 0 AND i < greatest(n // 12, 1) * 12))
    SELECT item_id, n AS total_rows, count(*) AS sampled_rows, md5('SQL Result Set (' || n || ' rows, 4 columns)' || chr(10) || 'Columns: sale_id, line_no, quantity, flag' || chr(10) || chr(10) || 'Sampling: ' ||
      CASE WHEN n <= 12 THEN 'All rows included' ELSE 'Every ' || greatest(n // 12, 1) || 'th row (sampled ' || count(*) || ' of ' || n || ')' END || chr(10) || chr(10) || string_agg('Row ' || pos || ': ' || line, chr(10) ORDER BY pos)) AS text_md5
    FROM k GROUP BY item_id, n"""
)
def result_evidence(w):
    """Each item's sale lines as a query's result: bounded text, every so many-th row."""
    lines = w["sale_lines"].where("item_id IS NOT NULL AND sale_id IS NOT NULL AND line_no IS NOT NULL")
    columns = ["sale_id", "line_no", "quantity", "flag"]
    found = evidence.result_texts(lines, "item_id", columns, columns, 12, how="stride")
    return found.select("item_id", "total_rows", "sampled_rows", F.md5("text").alias("text_md5"))


_TEMPLATES = [("facts", 1, "old {entity_id}"), ("facts", 2, "Facts of the {entity_type} {entity_id}.\n{evidence_content}\nEnd of {entity_id}."), ("brief", 1, "{entity_id}? {entity_type}!")]


@query(
    """WITH i AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY change_id, seq, op) AS i FROM (SELECT DISTINCT client_id, change_id, seq, op, city FROM client_changes WHERE client_id IS NOT NULL AND change_id IS NOT NULL)),
    e AS (SELECT client_id, count(*) AS n, string_agg('--- Evidence [inline:' || change_id || '] (type: inline_text) ---' || chr(10) || coalesce(city, '') || chr(10), chr(10) ORDER BY i) AS t FROM i WHERE i <= 5 GROUP BY client_id),
    j AS (SELECT DISTINCT client_id FROM clients WHERE client_id IS NOT NULL)
    SELECT CAST(client_id AS VARCHAR) AS job_id, k AS interrogation_key, coalesce(n, 0) AS n_items, CASE k WHEN 'brief' THEN CAST(client_id AS VARCHAR) || '? client!'
      ELSE 'Facts of the client ' || client_id || '.' || chr(10) || coalesce(t, '[No evidence provided]') || chr(10) || 'End of ' || client_id || '.' END AS prompt
    FROM (SELECT client_id, CASE client_id % 3 WHEN 0 THEN 'brief' WHEN 1 THEN 'facts' END AS k FROM j) LEFT JOIN e USING (client_id) WHERE k IS NOT NULL"""
)
def client_prompts(w):
    """Prompts on clients from a registry, with five changes of each as evidence."""
    key = F.when(F.col("client_id") % 3 == 0, "brief").when(F.col("client_id") % 3 == 1, "facts").otherwise("unknown")
    ids = w["clients"].where("client_id IS NOT NULL").select("client_id").distinct()
    jobs = ids.select(F.col("client_id").cast("string").alias("job_id"), key.alias("interrogation_key"), F.lit("client").alias("entity_type"), F.col("client_id").cast("string").alias("entity_id"))
    changes = w["client_changes"].where("client_id IS NOT NULL AND change_id IS NOT NULL").select("client_id", "change_id", "seq", "op", "city").distinct()
    few = evidence.sample_rows(changes, "client_id", ["change_id", "seq", "op"], 5)
    items = few.select(F.col("client_id").cast("string").alias("job_id"), F.col("change_id").alias("source_ordinal"), F.concat(F.lit("inline:"), F.col("change_id").cast("string")).alias("item_id"), F.lit("inline_text").alias("evidence_type"), F.col("city").alias("content"))
    registry = w.spark.createDataFrame(_TEMPLATES, "interrogation_key string, version int, prompt_template string")
    return evidence.prompts(jobs, registry, items)


@query(
    """SELECT strftime(valid_at, '%Y-%m-%d') AS dt, op, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs, min(valid_at) AS earliest, count(city) AS cities FROM client_changes
    WHERE valid_at >= TIMESTAMP '2024-02-10' AND valid_at < TIMESTAMP '2024-03-20' GROUP BY ALL"""
)
def snapshot_days(w):
    """The changes as a snapshot, written through the data source and read back for some days."""
    snapshot_source.register(w.spark)
    path, kinds = scratch(w.spark, "snapshot"), "change_id long, seq long, op string, valid_at timestamp_ntz, city string, dt string, bad_line string"
    rows = w["client_changes"].where("valid_at IS NOT NULL").select("change_id", "seq", "op", "valid_at", "city", F.date_format("valid_at", "yyyy-MM-dd").alias("dt"), F.lit(None).cast("string").alias("bad_line"))
    rows.write.format("narrata_snapshot").mode("append").save(path)
    found = w.spark.read.format("narrata_snapshot").schema(kinds).load(path).where("dt >= '2024-02-10' AND dt < '2024-03-20' AND bad_line IS NULL")
    return found.groupBy("dt", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"), F.min("valid_at").alias("earliest"), F.count("city").alias("cities"))
