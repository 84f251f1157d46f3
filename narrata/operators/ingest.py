"""Work items from seeds, request addresses, fetched texts, and the guard on evidence queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions.text import dedupe_key, truncate_bytes


def address(base: Column | str, **parameters: Column | str | int) -> Column:
    """An address with its parameters, encoded; a null parameter is left out."""
    base = F.lit(base) if isinstance(base, str) else base
    parts = [F.concat(F.lit(f"{name}="), F.url_encode((value if isinstance(value, Column) else F.lit(value)).cast("string"))) for name, value in parameters.items()]
    return F.concat_ws("?", base, F.nullif(F.concat_ws("&", *parts), F.lit("")))


def wiki_links(api: str, title: Column) -> Column:
    """The request for a page's links."""
    return address(api, action="query", format="json", titles=title, prop="links", pllimit=500)


def polite(url: Column, email: str | None) -> Column:
    """A citation API's address with the caller's e-mail, unless it has one or there is none."""
    if not email:
        return url
    joint = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.when(F.contains(url, F.lit("mailto=")), url).otherwise(F.concat(url, joint, F.lit("mailto="), F.url_encode(F.lit(email))))


def seed_items(spark: SparkSession, seeds: list[dict], sources: dict[str, dict]) -> DataFrame:
    """Work items of a seed configuration: page titles, works (ids get a W), DOIs, searches.

    Seeds of unknown sources, and empty ones, give nothing. The default priority is 10.
    """
    rows = []
    for seed in seeds:
        name = seed.get("source")
        if name in sources:
            kinds = {"titles": "title", "work_ids": "work", "dois": "doi", "search_query": "search"}
            for field, kind in kinds.items():
                values = seed.get(field) or []
                for value in [values] if isinstance(values, str) else values:
                    rows.append((sources[name]["type"], name, sources[name].get("api_url"), seed.get("resource_type", "page"), kind, str(value), int(seed.get("priority", 10))))
    items = spark.createDataFrame(rows, "source_system string, source_name string, api string, resource_type string, kind string, value string, priority int")
    value, api = F.col("value"), F.col("api")
    work = F.when(value.startswith("W"), value).otherwise(F.concat(F.lit("W"), value))
    uri = (
        F.when(F.col("kind") == "title", address(api, action="query", format="json", titles=value, prop="links", pllimit=500))
        .when(F.col("kind") == "work", F.concat_ws("/", api, F.lit("works"), work))
        .when(F.col("kind") == "doi", F.concat(api, F.lit("/works/doi:"), F.url_encode(value)))
        .otherwise(address(F.concat(api, F.lit("/works")), search=value))
    )
    key = F.when(F.col("kind") == "work", work).otherwise(value)
    return items.select(
        "source_system",
        "source_name",
        "resource_type",
        key.alias("resource_id"),
        uri.alias("request_uri"),
        "priority",
        dedupe_key(F.col("source_system"), F.col("source_name"), F.col("resource_type"), key).alias("dedupe_key"),
    ).dropDuplicates(["dedupe_key"])


def http_text(status: Column, reason: Column, url: Column, headers: Column, body: Column, limit: int) -> Column:
    """A response as text: its status, address and telling headers, then its body within the limit.

    The body has what the limit leaves after the head and a reserve of 100 bytes, but 1000 bytes at least.
    """
    lines = [F.concat_ws(" ", F.lit("HTTP"), F.coalesce(status.cast("string"), F.lit("UNKNOWN")), F.coalesce(reason, F.lit(""))), F.concat(F.lit("URL: "), F.coalesce(url, F.lit("unknown")))]
    lines += [F.concat(F.lit(f"{name}: "), headers[name]) for name in ("content-type", "content-length", "date")]
    head = F.concat_ws("\n", *lines)
    text = F.coalesce(body, F.lit(""))
    room = F.greatest(F.lit(limit) - F.octet_length(head) - 100, F.lit(1000))
    return F.concat(head, F.lit("\n\n--- Response Body ---\n"), truncate_bytes(text, room))


def run_select(spark: SparkSession, sql: str, limit: int = 100, **tables: DataFrame) -> DataFrame:
    """The first rows of a query; anything that isn't one SELECT (or WITH) statement is refused."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(re.sub(r"\{(\w+)\}", r"\1", sql))
    kind = plan.getClass().getSimpleName()
    if kind.endswith(("Command", "Statement")) or not sql.lstrip().upper().startswith(("SELECT", "WITH")):
        raise ValueError(f"only queries may run here, not {kind}")
    return spark.sql(sql, **tables).limit(limit)


def artifacts(outputs: DataFrame, content: str) -> DataFrame:
    """Outputs with the hash and the size that their record holds."""
    return outputs.withColumns({"content_sha256": F.sha2(content, 256), "byte_count": F.octet_length(content).cast("long")})

# The parameters of a wiki's requests, by kind; {} stands for what is asked for.
WIKI_REQUESTS: dict[str, dict[str, str | int]] = {
    "page": {"action": "query", "format": "json", "titles": "{}"},
    "page_by_id": {"action": "query", "format": "json", "pageids": "{}"},
    "search": {"action": "opensearch", "format": "json", "search": "{}", "limit": 10},
    "categories": {"action": "query", "format": "json", "titles": "{}", "prop": "categories", "cllimit": 500},
    "links": {"action": "query", "format": "json", "titles": "{}", "prop": "links", "pllimit": 500},
    "raw": {"action": "query", "format": "json", "pageids": "{}", "prop": "revisions", "rvprop": "content", "rvslots": "main"},
    "html": {"action": "parse", "format": "json", "pageid": "{}", "prop": "text"},
}


def wiki_request(api: Column | str, kind: str, asked: Column) -> Column:
    """The address of a wiki's request: a page by title or id, a search, its categories, links, source or HTML."""
    return address(api, **{k: asked if v == "{}" else v for k, v in WIKI_REQUESTS[kind].items()})


_PAGE = "struct<pageid: bigint, title: string, links: array<struct<title: string>>, categories: array<struct<title: string>>>"


def wiki_pages(records: DataFrame, payload: str = "payload") -> DataFrame:
    """The pages of wiki payloads, one row each, as column page after the record's own.

    payload.query.pages is an object by page id, or an array; the object's key -1 marks a missing page.
    """
    text = F.get_json_object(payload, "$.query.pages")
    by_id = F.map_values(F.map_filter(F.from_json(text, f"map<string, {_PAGE}>"), lambda k, v: k != "-1"))
    listed = F.from_json(text, f"array<{_PAGE}>")
    pages = F.when(text.startswith("["), listed).otherwise(by_id)
    return records.withColumn("page", F.explode(pages))


def wiki_edges(records: DataFrame, payload: str = "payload") -> DataFrame:
    """(page_id, title, target), a row for each link occurrence of each page."""
    pages = wiki_pages(records, payload).select(F.col("page.pageid").alias("page_id"), F.col("page.title").alias("title"), "page.links")
    return pages.select("page_id", "title", F.explode("links.title").alias("target"))


def wiki_children(records: DataFrame, payload: str = "payload", max_depth: int = 1) -> DataFrame:
    """Work items for the links (10 later) and the categories (20 later) of fetched pages above the depth limit."""
    from narrata.operators.graph import discover

    pages = wiki_pages(records.where(F.col("depth") < max_depth), payload)
    found = discover(pages, F.col("page.links.title"), "page", 10, max_depth)
    return found.unionByName(discover(pages, F.col("page.categories.title"), "category", 20, max_depth))


_WORK = "struct<id: string, doi: string, title: string, display_name: string, concepts: array<struct<display_name: string>>, referenced_works: array<string>>"


def cited_works(records: DataFrame, payload: str = "payload") -> DataFrame:
    """(work_id, identifier, title, concepts, refs) of citation payloads: one work, or a list under results."""
    text = F.col(payload)
    listed = F.from_json(F.get_json_object(text, "$.results"), f"array<{_WORK}>")
    works = F.coalesce(listed, F.array(F.from_json(text, _WORK)))
    from narrata.operators.graph import clean_identifier

    return records.withColumn("w", F.explode(works)).where("w.id IS NOT NULL").select(
        *records.columns,
        clean_identifier(F.col("w.id")).alias("work_id"),
        clean_identifier(F.col("w.doi")).alias("identifier"),
        F.coalesce("w.title", "w.display_name").alias("title"),
        F.col("w.concepts.display_name").alias("concepts"),
        F.transform(F.col("w.referenced_works"), clean_identifier).alias("refs"),
    )
