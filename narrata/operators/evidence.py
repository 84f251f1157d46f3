"""Evidence: sampling of result rows, bounding of bundles, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import text


def sample_rows(df: DataFrame, group: str, order: list[str], most: int, how: str = "first_only", max_cols: int | None = None) -> DataFrame:
    """Rows of each group in a sample of at most most: first_only, first_last (half and half) or stride.

    max_cols keeps the first columns only.

    A half of no rows means all rows for the last half, as a slice from -0 does.
    """
    if how not in ("first_only", "first_last", "stride"):
        raise ValueError(f"no such sampling: {how}")
    w = Window.partitionBy(group)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)), "_n": F.count(F.lit(1)).over(w)})
    half = most // 2
    if how == "first_only":
        hit = F.col("_i") <= most
    elif how == "first_last":
        hit = (F.col("_i") <= half) | (F.col("_i") > F.col("_n") - half) | F.lit(half == 0)
    else:
        stride = F.greatest(F.floor(F.col("_n") / most), F.lit(1))
        hit = ((F.col("_i") - 1) % stride == 0) & ((F.col("_i") - 1) < stride * most)
    return rows.where((F.col("_n") <= most) | hit).select(*(df.columns if max_cols is None else df.columns[:max_cols]))


def bound_bundles(items: DataFrame, bundle: str, order: list[str], size: str, max_items: int = 50, max_bytes: int = 100_000) -> DataFrame:
    """(bundle, ids, bytes): each bundle's first max_items, less those that would pass the budget when their turn comes.

    An item that doesn't fit is passed over and a later, smaller one may still go in; so this is a fold over
    the ordered items, not a running sum. item_id names the items.
    """
    w = Window.partitionBy(bundle).orderBy(*order)
    first = items.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= max_items)
    lists = first.groupBy(bundle).agg(F.sort_array(F.collect_list(F.struct("_i", F.col("item_id").alias("id"), F.col(size).cast("long").alias("n")))).alias("items"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(items.dtypes)['item_id']}>").alias("ids"))

    def take(seen, item):
        fits = seen["used"] + item["n"] <= max_bytes
        return F.struct(F.when(fits, seen["used"] + item["n"]).otherwise(seen["used"]).alias("used"), F.when(fits, F.concat(seen["ids"], F.array(item["id"]))).otherwise(seen["ids"]).alias("ids"))

    return lists.select(bundle, F.aggregate("items", empty, take).alias("r")).select(bundle, F.col("r.ids").alias("ids"), F.col("r.used").alias("bytes"))


def summary(items: DataFrame) -> DataFrame:
    """Items, bytes and estimated tokens (four bytes each) by type."""
    out = items.groupBy("evidence_type").agg(F.count(F.lit(1)).alias("items"), F.sum("byte_count").alias("bytes"))
    return out.withColumn("tokens", F.floor(F.col("bytes") / 4))


def check_facts(outputs: DataFrame, column: str) -> DataFrame:
    """Each output with its fault: not an object, a missing field, no facts, a fact without key or with a confidence out of range."""
    schema = "entity_type string, entity_id string, facts array<struct<fact_key string, confidence double, evidence_ids array<string>>>"
    x = F.from_json(column, schema)
    bad = F.exists(x["facts"], lambda f: f["fact_key"].isNull() | ~F.coalesce(f["confidence"], F.lit(1.0)).between(0, 1))
    fault = (
        F.when(x.isNull() | (x["entity_type"].isNull() & x["entity_id"].isNull() & x["facts"].isNull()), "not an output")
        .when(x["entity_type"].isNull() | x["entity_id"].isNull(), "missing field")
        .when(x["facts"].isNull(), "no facts")
        .when(bad, "bad fact")
    )
    return outputs.withColumn("fault", fault)

# The defaults of an evidence policy.
POLICY = {"max_items": 50, "max_total_bytes": 100_000, "max_item_bytes": 10_000, "max_sql_rows": 100, "max_sql_cols": 20, "chunk_size": 2000, "chunk_overlap": 200, "sampling_strategy": "first_only"}


def policy_faults(policy: dict) -> list[str]:
    """What is wrong with a policy; an empty list if nothing is."""
    p = POLICY | policy
    rules = {
        "max_items must be at least 1": p["max_items"] >= 1,
        "max_total_bytes must be at least 1000": p["max_total_bytes"] >= 1000,
        "max_item_bytes must be at least 100": p["max_item_bytes"] >= 100,
        "max_item_bytes must not exceed max_total_bytes": p["max_item_bytes"] <= p["max_total_bytes"],
        "max_sql_rows must be at least 1": p["max_sql_rows"] >= 1,
        "max_sql_cols must be at least 1 if given": not p["max_sql_cols"] or p["max_sql_cols"] >= 1,
        "chunk_size must be at least 100": p["chunk_size"] >= 100,
        "chunk_overlap must not be negative": p["chunk_overlap"] >= 0,
        "chunk_overlap must be below chunk_size": p["chunk_overlap"] < p["chunk_size"],
        "sampling_strategy is unknown": p["sampling_strategy"] in ("first_only", "first_last", "stride"),
    }
    return [what for what, holds in rules.items() if not holds]


def load_items(texts: DataFrame, max_item_bytes: int = POLICY["max_item_bytes"]) -> DataFrame:
    """Items of evidence from texts (bundle, source_ordinal, evidence_type, source_ref, text), in one pass.

    Texts are redacted, then cut; responses are cut before they are redacted; query definitions aren't redacted.
    """
    kind, raw = F.col("evidence_type"), F.coalesce("text", F.lit(""))
    cut_first = text.redact(text.truncate_bytes(raw, max_item_bytes))
    content = (
        F.when(kind == "lake_http", cut_first)
        .when(kind == "sql_query_def", text.truncate_bytes(raw, max_item_bytes))
        .otherwise(text.truncate_bytes(text.redact(raw), max_item_bytes))
    )
    return texts.select(
        "bundle",
        "source_ordinal",
        "evidence_type",
        text.evidence_id(kind, F.coalesce("source_ref", F.lit("")), F.col("source_ordinal")).alias("item_id"),
        content.alias("content"),
        F.sha2(content, 256).alias("content_sha256"),
        F.octet_length(content).cast("long").alias("byte_count"),
        (F.octet_length(raw) > max_item_bytes).alias("cut"),
    )


def result_texts(rows: DataFrame, ref: str, order: list[str], columns: list[str], max_rows: int = POLICY["max_sql_rows"], max_cols: int | None = POLICY["max_sql_cols"], how: str = "first_only") -> DataFrame:
    """(ref, text, total_rows, sampled_rows): each query result of rows, told apart by ref, as bounded text.

    A head with the numbers of rows and columns, the columns' names, how rows were sampled, then a line of
    JSON for each sampled row. Rows stand in the given order. The sample is drawn before rows are gathered,
    so a text takes max_rows rows at most, whatever its result holds. A result without rows isn't there.
    """
    shown = columns[:max_cols] if max_cols else columns
    sizes = rows.groupBy(ref).agg(F.count(F.lit(1)).alias("total_rows"))
    cells = [F.concat(F.lit(f'"{c}": '), F.expr(f"substring(to_json(array(`{c}`)), 2, length(to_json(array(`{c}`))) - 2)")) for c in shown]
    line = F.concat(F.lit("{"), F.concat_ws(", ", *cells), F.lit("}"))
    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    lines = rows.select(F.col(ref), *keys, line.alias("_line"))
    sample = sample_rows(lines, ref, [f"_o{i}" for i in range(len(order))], max_rows, how)
    at = F.row_number().over(Window.partitionBy(ref).orderBy(*(f"_o{i}" for i in range(len(order))))) - 1
    numbered = sample.select(ref, F.struct(at.alias("i"), F.concat(F.lit("Row "), at.cast("string"), F.lit(": "), F.col("_line")).alias("line")).alias("_row"))
    body = numbered.groupBy(ref).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    total, half, stride = F.col("total_rows").cast("string"), max_rows // 2, F.greatest(F.floor(F.col("total_rows") / max_rows), F.lit(1)).cast("string")
    n = F.size("_rows").cast("string")
    note = {
        "first_only": F.concat(F.lit(f"First {max_rows} rows of "), total),
        "first_last": F.concat(F.lit(f"First {half} and last {half} rows of "), total),
        "stride": F.concat(F.lit("Every "), stride, F.lit("th row (sampled "), n, F.lit(" of "), total, F.lit(")")),
    }[how]
    head = [F.concat(F.lit("SQL Result Set ("), total, F.lit(f" rows, {len(columns)} columns)")), F.lit(f"Columns: {', '.join(shown)}")]
    head += [F.lit(f"(Note: Showing {len(shown)} of {len(columns)} columns)")] if len(shown) < len(columns) else []
    head += [F.lit(""), F.concat(F.lit("Sampling: "), F.when(F.col("total_rows") <= max_rows, "All rows included").otherwise(note)), F.lit("")]
    text_ = F.concat_ws("\n", *head, F.array_join(F.col("_rows.line"), "\n"))
    return body.join(sizes, ref).select(ref, text_.alias("text"), "total_rows", F.size("_rows").cast("long").alias("sampled_rows"))


#: How a result artifact is stored, besides its own columns' names.
RESULT = "struct<columns: array<string>, rows: array<array<variant>>, row_count: bigint, query: string>"


def stored_results(artifacts: DataFrame) -> DataFrame:
    """(lake_uri, row_index, column_index, name, value) of result artifacts (lake_uri, text), value as JSON text.

    A text that isn't a result has no cells; a row's cells beyond the named columns are left out.
    """
    parsed = artifacts.select("lake_uri", F.from_json("text", RESULT).alias("r"))
    rows = parsed.select("lake_uri", F.col("r.columns").alias("names"), F.posexplode("r.rows").alias("row_index", "cells"))
    cells = rows.select("lake_uri", "row_index", "names", F.posexplode("cells").alias("column_index", "cell")).where("column_index < size(names)")
    return cells.select("lake_uri", "row_index", "column_index", F.element_at("names", F.col("column_index") + 1).alias("name"), F.coalesce(F.to_json("cell"), F.lit("null")).alias("value"))


def prompts(jobs: DataFrame, registry: DataFrame, items: DataFrame) -> DataFrame:
    """(job_id, interrogation_key, n_items, prompt): each job's template, filled with its entity and evidence.

    jobs: job_id, interrogation_key, entity_type, entity_id; registry: interrogation_key, prompt_template with
    {entity_type}, {entity_id} and {evidence_content}; items: job_id, source_ordinal, item_id, evidence_type,
    content, bounded beforehand (`bound_bundles`). Of several definitions of a key the last registered
    (version) counts. Jobs of unknown keys are left out; a job without items says so. Values aren't searched
    for placeholders.
    """
    latest = registry.groupBy("interrogation_key").agg(F.max_by("prompt_template", F.struct("version", "prompt_template")).alias("_template"))
    part = F.concat(F.lit("--- Evidence ["), F.col("item_id"), F.lit("] (type: "), F.col("evidence_type"), F.lit(") ---\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    gathered = items.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("source_ordinal", "item_id", part.alias("part")))).alias("_parts"))
    rows = jobs.join(latest, "interrogation_key").join(gathered, "job_id", "left")
    evidence = F.coalesce(F.array_join(F.col("_parts.part"), "\n"), F.lit("[No evidence provided]"))
    values = {"entity_type": F.col("entity_type"), "entity_id": F.col("entity_id"), "evidence_content": evidence}
    # The template is split at its placeholders, so that what is filled in is never read as one.
    pieces = F.regexp_extract_all("_template", F.lit(r"(?s)(\{(?:entity_type|entity_id|evidence_content)\}|.+?(?=\{(?:entity_type|entity_id|evidence_content)\}|$))"), F.lit(1))
    filled = rows.withColumn("_values", F.create_map(*(x for name, v in values.items() for x in (F.lit("{" + name + "}"), F.coalesce(v, F.lit(""))))))
    prompt = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.col("_values")[p], p)), "")
    return filled.select("job_id", "interrogation_key", F.coalesce(F.size("_parts"), F.lit(0)).cast("long").alias("n_items"), prompt.alias("prompt"))
