"""Slowly changing rows: chains of versions with the time each was valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import text
from narrata.functions.times import DAY, micros, slot
from narrata.operators.ordered import before
from narrata.sources.shared import kept

CHAIN = ("ValidFromUtc", "ValidToUtc", "VersionNum", "RowHash", "IsActive", "IsLatest")


def versions(changes: DataFrame, keys: list[str], at: str, ties: list[str], attributes: list[str], deleted: Column | None = None, width: int = 7 * DAY) -> DataFrame:
    """The version chain of each key: keys, attributes, ValidFromUtc, ValidToUtc, VersionNum, RowHash, IsActive, IsLatest.

    A change counts if the row's hash, of its attributes and whether it is deleted, differs from the one before.
    A version is valid until the next one begins (the last has no end), so validity has no gaps and one row of
    a key is the latest. Of changes of one key and time the one with the greatest ties counts. deleted rows are
    versions that aren't active; a change back to the same attributes is a version again. Changes without a key
    or a time are left out, repeated ones count once. Keys with many changes are spread over slots of width
    microseconds.
    """
    usable = changes.where(F.expr(" and ".join(f"`{c}` is not null" for c in (*keys, at))))
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    last = usable.groupBy(*keys, F.col(at).alias("ValidFromUtc")).agg(F.max_by(F.struct(*attributes, (~gone).alias("IsActive")), F.struct(*ties, *attributes)).alias("_row"))
    rows = last.select(*keys, "ValidFromUtc", "_row.*")
    rows = rows.withColumn("RowHash", text.row_hash(rows, (*keys, "ValidFromUtc"))).withColumn("_slot", slot(micros("ValidFromUtc"), width))
    begun = before(rows, keys, "_slot", ["ValidFromUtc"], {"_earlier": ("last", F.col("RowHash"))}).where("_earlier IS NULL OR _earlier <> RowHash")
    begun = kept(begun.drop("_earlier"), "versions")
    numbered = before(begun, keys, "_slot", ["ValidFromUtc"], {"VersionNum": ("sum", F.lit(1).cast("long"))}, inclusive=True)
    ended = before(numbered, keys, "_slot", ["ValidFromUtc"], {"ValidToUtc": ("last", F.col("ValidFromUtc"))}, reverse=True)
    return ended.withColumn("IsLatest", F.col("ValidToUtc").isNull()).select(*keys, *attributes, *CHAIN)


def merge(history: DataFrame, changes: DataFrame, keys: list[str], at: str, ties: list[str], attributes: list[str], deleted: Column | None = None, width: int = 7 * DAY) -> DataFrame:
    """History after a load of changes, some of them late, with action: left, closed or opened.

    A change holds from its time until the next version known, so a late one falls in between and ends the
    version it falls into; one that says what already holds changes nothing. A change at the very time of a
    version takes its place. Keys without changes are copied as they are; the chains of the others are made
    again from their versions and the changes in one pass. closed: a version with another end than before.
    """
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    new = changes.where(F.expr(" and ".join(f"`{c}` is not null" for c in (*keys, at))))
    touched = new.select(*keys).distinct()
    # A version is an old change; the order (1, ties) of new ones puts them last at equal times.
    tie = F.struct(*ties)
    kind = new.select(tie.alias("_tie")).schema["_tie"].dataType
    old = history.join(touched, keys, "left_semi").select(*keys, F.col("ValidFromUtc").alias("_at"), F.lit(0).alias("_new"), F.lit(None).cast(kind).alias("_tie"), *attributes, (~F.col("IsActive")).alias("_gone"))
    added = new.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_new"), tie.alias("_tie"), *attributes, gone.alias("_gone"))
    made = versions(old.unionByName(added), keys, "_at", ["_new", "_tie"], attributes, F.col("_gone"), width)
    was = history.select(*keys, "ValidFromUtc", "RowHash", F.col("ValidToUtc").alias("_to"), F.lit(True).alias("_was"))
    compared = made.join(was, [*keys, "ValidFromUtc", "RowHash"], "left")
    action = F.when(F.col("_was").isNull(), "opened").when(F.col("_to").eqNullSafe(F.col("ValidToUtc")), "left").otherwise("closed")
    same = history.join(touched, keys, "left_anti").withColumn("action", F.lit("left"))
    columns = [*keys, *attributes, *CHAIN, "action"]
    return compared.withColumn("action", action).select(*columns).unionByName(same.select(*columns))


def broken_chains(history: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose chain isn't whole, with n_latest, n_overlong and n_gaps; none after `versions` or `merge`.

    n_overlong counts versions that end before they begin, n_gaps those whose end no version of the key begins at.
    """
    starts = history.select(*keys, F.col("ValidFromUtc").alias("ValidToUtc"), F.lit(1).alias("_next")).distinct()
    joined = history.join(starts, [*keys, "ValidToUtc"], "left")
    found = joined.groupBy(*keys).agg(
        F.count_if("IsLatest").alias("n_latest"),
        F.count_if(F.col("ValidToUtc") <= F.col("ValidFromUtc")).alias("n_overlong"),
        F.count_if(F.col("ValidToUtc").isNotNull() & F.col("_next").isNull()).alias("n_gaps"),
    )
    return found.where("n_latest <> 1 OR n_overlong > 0 OR n_gaps > 0")
