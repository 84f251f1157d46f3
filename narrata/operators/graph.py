"""Link rank, discovery and matching over crawled pages and works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.operators import grams
from narrata.operators.relational import few
from narrata.sources.shared import kept


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, target), one row for each link occurrence of a page's HTML."""
    return pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


def link_rank(titles: DataFrame, links: DataFrame) -> DataFrame:
    """(title, page_id, inbound): link occurrences that point at each title, linked or known.

    titles has (page_id, title), links has target. The smallest page_id of a title counts; a target that no
    page has as its title has none. Titles that differ in case are different.
    """
    known = titles.groupBy("title").agg(F.min("page_id").alias("page_id"))
    counts = links.groupBy(F.col("target").alias("title")).agg(F.count(F.lit(1)).alias("inbound"))
    return known.join(counts, "title", "full").withColumn("inbound", F.coalesce("inbound", F.lit(0)))


def top_pages(rank: DataFrame, n: int, with_id: bool = True) -> DataFrame:
    found = rank.where("page_id IS NOT NULL") if with_id else rank
    return found.orderBy(F.desc("inbound"), "title").limit(n)


def content_seeds(ranked: DataFrame, system: str, name: str, priority: int = 50) -> DataFrame:
    """Two work items for each ranked page with an id: its raw text and its HTML."""
    return ranked.where("page_id IS NOT NULL").select(
        F.lit(system).alias("source_system"),
        F.lit(name).alias("source_name"),
        F.explode(F.array(F.lit("raw"), F.lit("html"))).alias("resource_type"),
        F.col("page_id").cast("string").alias("resource_id"),
        F.lit(priority).alias("priority"),
    )


def discover(records: DataFrame, targets: Column, kind: str, step: int = 10, max_depth: int = 1) -> DataFrame:
    """Work items for the targets of records above the depth limit; a child is one deeper and step later."""
    rows = records.where(F.col("depth") < max_depth).withColumn("target", F.explode(targets))
    return rows.select(
        "source_system",
        "source_name",
        F.lit(kind).alias("resource_type"),
        F.col("target").alias("resource_id"),
        (F.col("priority") + step).alias("priority"),
        (F.col("depth") + 1).alias("depth"),
        F.col("resource_id").alias("discovered_from"),
    ).where(F.col("resource_id").isNotNull())


def discover_cited(works: DataFrame, entities: DataFrame, identifiers: DataFrame | None = None, max_depth: int = 1) -> DataFrame:
    """Work items for what the works (work_id, title, concepts, identifier, refs, depth, priority) cite.

    Only works above the depth limit that name a known entity lead on; a cited work is one deeper.
    """
    open_ = works.where(F.col("depth") < max_depth)
    matched = open_.join(match_entities(open_, entities, identifiers), "work_id", "left_semi")
    return discover(matched.withColumn("resource_id", F.col("work_id")), F.col("refs"), "work", 10, max_depth)


def clean_identifier(x: Column) -> Column:
    """A DOI without its resolver, or the last segment of an identifier's address."""
    bare = F.regexp_replace(x, r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.when(bare != x, bare).otherwise(F.element_at(F.split(x, "/"), -1))


def match_entities(works: DataFrame, entities: DataFrame, identifiers: DataFrame | None = None, case_sensitive: bool = False) -> DataFrame:
    """Works (work_id, title, concepts, identifier) that name a known entity (entity).

    An identifier matches exactly, a title by containing an entity, a concept by being one. Identifiers and
    concepts are semi-joins, titles an index of grams (`grams.containing`). Null and empty names match
    nothing; repeated works and names count once.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    names = kept(entities.select(fold(F.col("entity")).alias("name")).where("name <> ''").distinct(), "names")
    titles = works.select(F.col("work_id").alias("text_id"), fold(F.col("title")).alias("text"))
    spread = works.select("work_id", F.explode("concepts").alias("concept")).select("work_id", fold(F.col("concept")).alias("name"))
    found = spread.join(few(names, "octet_length(name)"), "name", "left_semi").select("work_id")
    found = found.unionByName(grams.containing(titles, names).select(F.col("text_id").alias("work_id")))
    if identifiers is not None:
        found = found.unionByName(works.join(few(identifiers, "octet_length(identifier)"), "identifier", "left_semi").select("work_id"))
    return found.distinct()


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth) of the nodes within max_depth links of the seeds, each at its least depth.

    One join for each level, written to the shared folder, so no level plans the earlier ones again; what is
    known is left out by an anti-join, so no node is expanded twice. A level without new nodes ends it.
    """
    known = kept(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "crawl")
    frontier, levels = known, known
    for depth in range(1, max_depth + 1):
        reached = edges.join(few(frontier.select(F.col("node").alias("source"))), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = kept(reached.join(levels.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "crawl")
        if frontier.isEmpty():
            break
        levels = levels.unionByName(frontier)
    return levels


def closure(children: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of a hierarchy (node, parent): every node, its ancestors and itself.

    Distances double from round to round: the ancestors at up to twice the distance are the ancestors of
    ancestors, so a hierarchy of depth d takes about log2(d) rounds, each written to the shared folder. A node
    that is its own ancestor raises an error. Null nodes drop out; several parents give several ancestors,
    each at its least distance.
    """
    rows = children.where("node IS NOT NULL")
    pairs = kept(rows.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct(), "closure")
    n = pairs.count()
    while n:
        further = pairs.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("above"), F.col("distance").alias("more"))
        longer = pairs.join(further, "ancestor").select("node", F.col("above").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        pairs = kept(pairs.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "closure")
        if not pairs.where("node = ancestor").isEmpty():
            raise ValueError("the hierarchy has a cycle")
        before, n = n, pairs.count()
        if n == before:
            break
    own = rows.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).distinct()
    return own.unionByName(pairs)
