"""Content-addressed snapshots: what to import, what to export, who wins a conflict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("prefer_newest", "prefer_sql", "prefer_json", "fail")


def index(records: DataFrame) -> DataFrame:
    """The first record of each content hash, by time and id."""
    w = Window.partitionBy("content_sha256").orderBy(F.col("observed_at").asc_nulls_last(), "record_id")
    return records.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_key(records: DataFrame) -> DataFrame:
    """The hashes seen for each natural key, in order."""
    return records.groupBy("natural_key").agg(F.sort_array(F.collect_set("content_sha256")).alias("hashes"))


def resolve(strategy: str, json_time: Column, sql_time: Column, prefer_json: bool = True) -> Column:
    """Who wins: by time the newer side, JSON on a tie, the side with a time if one has none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    if strategy != "prefer_newest":
        return F.lit({"prefer_sql": "sql_wins", "prefer_json": "json_wins", "fail": "failed"}[strategy])
    return (
        F.when(json_time.isNotNull() & sql_time.isNotNull(), F.when(json_time >= sql_time, "json_wins").otherwise("sql_wins"))
        .when(json_time.isNotNull(), "json_wins")
        .when(sql_time.isNotNull(), "sql_wins")
        .otherwise("json_wins" if prefer_json else "sql_wins")
    )


def import_plan(json_side: DataFrame, sql_side: DataFrame, strategy: str = "prefer_newest") -> DataFrame:
    """For each JSON record: action skip (its hash is known), insert, update, keep (SQL wins) or failed."""
    known = sql_side.select("content_sha256").distinct().withColumn("_known", F.lit(True))
    newest = sql_side.where("natural_key IS NOT NULL").groupBy("natural_key").agg(F.max("observed_at").alias("_sql_at")).withColumn("_has", F.lit(True))
    both = json_side.join(known, "content_sha256", "left").join(newest, "natural_key", "left")
    won = resolve(strategy, F.col("observed_at"), F.col("_sql_at"))
    action = (
        F.when(F.col("_known"), "skip")
        .when(F.col("_has").isNull(), "insert")
        .when(won == "json_wins", "update")
        .when(won == "sql_wins", "keep")
        .otherwise("failed")
    )
    return both.withColumn("action", action).drop("_known", "_has", "_sql_at")


def apply_import(plan: DataFrame, sql_side: DataFrame) -> DataFrame:
    """The SQL side after the plan: updated keys are replaced in all their rows, inserts added, the rest kept."""
    taken = plan.where("action IN ('insert', 'update')").drop("action")
    replaced = plan.where("action = 'update'").select("natural_key").distinct()
    return sql_side.join(replaced, "natural_key", "left_anti").unionByName(taken.select(*sql_side.columns))


def to_export(sql_side: DataFrame, json_side: DataFrame) -> DataFrame:
    """SQL records whose hash the JSON side doesn't have."""
    return sql_side.join(json_side.select("content_sha256").distinct(), "content_sha256", "left_anti")


def report(plan: DataFrame, exported: DataFrame) -> DataFrame:
    """Counts by action, and of exports."""
    counts = plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(exported.agg(F.count(F.lit(1)).alias("n")).select(F.lit("export").alias("action"), "n"))


def upsert(target: DataFrame, source: DataFrame, *key: str) -> DataFrame:
    """target with source's rows in place of those of the same key: a merge for tables without one."""
    return target.join(source.select(*key).distinct(), list(key), "left_anti").unionByName(source)


def corrupt(records: DataFrame, content: Column, stored: str = "content_sha256") -> DataFrame:
    """The records whose stored hash isn't that of their content; a missing hash is wrong too."""
    return records.where(~F.col(stored).eqNullSafe(F.sha2(content, 256)))


def sync_report(json_side: DataFrame, sql_side: DataFrame, strategy: str = "prefer_newest", dry_run: bool = False) -> DataFrame:
    """One row of a two-way sync: records of either side before, what the import does, what the export adds.

    The import comes first; the export then writes what the SQL side has and the JSON side hasn't. In a dry
    run nothing is imported, so exports are counted on the SQL side as it is.
    """
    plan = import_plan(json_side, sql_side, strategy)
    after = sql_side if dry_run else apply_import(plan, sql_side)
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    actions = plan.agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in (("insert", "inserted"), ("update", "updated"), ("keep", "kept"), ("skip", "skipped"), ("failed", "failed"))))
    out = one(json_side, "json_records").crossJoin(one(sql_side, "sql_records")).crossJoin(actions)
    return out.crossJoin(one(to_export(after, json_side), "exported")).withColumn("dry_run", F.lit(dry_run))
