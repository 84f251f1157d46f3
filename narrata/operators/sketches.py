"""Approximate aggregates that are stored by day, say, and merged later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct count (error about 1.04 / sqrt(4096), 1.6 %), the size of a quantile
#: sketch (rank error about 1.3 %), and the items that a heavy-hitter sketch follows.
REGISTERS, QUANTILES, FOLLOWED = 12, 200, 10_000


def sketched(df: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """(by, n, items, values, heavy): for each group its rows, and sketches of a column's distinct items, its values and its heavy hitters.

    Nulls are left out of the sketches. Each has a fixed size, whatever the group's rows, and tasks build
    theirs before the shuffle.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg(F.col(item), F.lit(REGISTERS)).alias("items"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILES)).alias("values"),
        F.expr(f"approx_top_k_accumulate({item}, {FOLLOWED})").alias("heavy"),
    )


def merged(sketches: DataFrame, by: list[str], quantiles: list[float], k: int = 10) -> DataFrame:
    """(by, n, n_items, q_<percent> ..., top): estimates of merged sketches; top is an array of (item, count)."""
    union = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.hll_sketch_estimate(F.hll_union_agg("items")).alias("n_items"),
        F.kll_merge_agg_double("values").alias("_values"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(heavy, {FOLLOWED}), {k})").alias("top"),
    )
    found = {f"q_{round(100 * q)}": F.kll_sketch_get_quantile_double("_values", F.lit(float(q))) for q in quantiles}
    return union.withColumns(found).drop("_values")
