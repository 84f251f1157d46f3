"""Joins of intervals that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions.times import slot

#: Rows of one key and bin on the left that one task joins; beyond them the bin's left rows are dealt out.
DEALT = 20_000


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, width: int, suffix: str = "_right") -> DataFrame:
    """Pairs of rows of equal keys whose half-open intervals [start, end) overlap; right's columns get the suffix.

    start and end are whole numbers of either side; a null end is open, an interval that isn't longer than
    nothing, or without a start or a key, overlaps nothing. Every row stands in each bin of width that it
    touches, and bins are joined by equality; a pair that shares several bins is kept in the one where the
    later of the two starts. Open and long intervals stand only in bins that the other side reaches: from its
    first start to its last end. A bin with very many left rows is dealt out, the right ones going to each part.
    """
    if width < 1:
        raise ValueError("bins have a width")
    usable = F.expr(" and ".join(f"`{c}` is not null" for c in (*keys, start)) + f" and (`{end}` is null or `{end}` > `{start}`)")
    reach = lambda side: side.agg(F.min(start).alias("first"), F.max(end).alias("last"), F.max(start).alias("start")).first()
    left, right = left.where(usable), right.where(usable)
    a, b = reach(left), reach(right)  # three numbers of each side
    if a["first"] is None or b["first"] is None:
        low, high = 0, 0
    else:
        low = max(a["first"], b["first"])
        high = max(x for x in (a["start"], b["start"], a["last"], b["last"]) if x is not None)

    def binned(side: DataFrame, cut: int) -> DataFrame:
        until = F.least(F.coalesce(F.col(end), F.lit(cut + 1)), F.lit(cut + 1)).cast("long") - 1
        since = F.greatest(F.col(start), F.lit(low)).cast("long")
        bins = F.when(since <= until, F.sequence(slot(since, width), slot(until, width)))
        return side.withColumn("_bin", F.explode(bins))

    a_bins, b_bins = binned(left, high), binned(right, high)
    by = [*keys, "_bin"]
    heavy = a_bins.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > DEALT).select(*by, F.ceil(F.col("_n") / DEALT).cast("int").alias("_parts"))
    number = F.pmod(F.xxhash64(*left.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    a_bins = a_bins.join(heavy, by, "left").withColumn("_part", number).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    b_bins = b_bins.join(heavy, by, "left").withColumn("_part", F.explode(parts)).drop("_parts")
    renamed = b_bins.select(*by, "_part", *(F.col(c).alias(f"{c}{suffix}") for c in right.columns if c not in keys))
    later = F.greatest(F.col(start), F.col(f"{start}{suffix}"))
    meet = (F.col(end).isNull() | (later < F.col(end))) & (F.col(f"{end}{suffix}").isNull() | (later < F.col(f"{end}{suffix}")))
    once = F.col("_bin") == slot(F.greatest(later, F.lit(low)).cast("long"), width)
    return a_bins.join(renamed, [*by, "_part"]).where(meet & once).drop("_bin", "_part")
