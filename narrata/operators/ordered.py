"""Values carried along ordered rows of a key, with keys of any size.

A window over a whole key puts all rows of the key into one task. Here the rows of a key are cut into blocks,
by time for instance; a window runs within each block, each block is summed up to one row, those few rows
run through a window over the key, and what comes before a block is joined to its rows. So no task holds
more than a block's rows of one key, and a key's blocks are as many as its time span has slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions.times import DAY, micros, slot

KINDS = ("last", "max", "sum")


def before(rows: DataFrame, keys: list[str], block: str, order: list[str], values: dict[str, tuple[str, Column]], inclusive: bool = False, reverse: bool = False) -> DataFrame:
    """The rows with, for each value (kind, column), what the rows before it in its key have.

    last is the nearest non-null value, max the greatest, sum the total (0 if there is none). inclusive counts
    the row itself; reverse looks at the rows after it. Blocks must ascend with the order. Rows that tie in the
    order stand in any order, so it should end in a unique column. Null keys count as one key; a null block
    or order column stands first.
    """
    if any(kind not in KINDS for kind, _ in values.values()):
        raise ValueError(f"kinds are {', '.join(KINDS)}")
    ends = (lambda c: F.desc(c)) if reverse else (lambda c: F.asc(c))
    inner = Window.partitionBy(*keys, block).orderBy(*map(ends, order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    outer = Window.partitionBy(*keys).orderBy(ends(block)).rowsBetween(Window.unboundedPreceding, -1)
    over = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "sum": F.sum}
    nearest = F.min_by if reverse else F.max_by
    place = F.struct(*order)

    def whole(kind: str, c: Column) -> Column:
        return nearest(c, F.when(c.isNotNull(), place)) if kind == "last" else over[kind](c)

    def both(kind: str, a: Column, b: Column) -> Column:
        return {"last": F.coalesce(a, b), "max": F.greatest(a, b), "sum": F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}[kind]

    blocks = rows.groupBy(*keys, block).agg(*(whole(kind, c).alias(name) for name, (kind, c) in values.items()))
    carried = blocks.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, block])), *(over[kind](F.col(name)).over(outer).alias(f"_{name}") for name, (kind, _) in values.items()))
    local = rows.withColumns({name: over[kind](c).over(inner) for name, (kind, c) in values.items()})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, block])]
    joined = local.join(carried, same, "left")
    kept = [c for c in local.columns if c not in values]
    return joined.select(*kept, *(both(kind, F.col(name), F.col(f"_{name}")).alias(name) for name, (kind, _) in values.items()))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], ties: list[str] | None = None, width: int = DAY) -> DataFrame:
    """The left rows, each with the columns take of the last right row of its keys at or before it.

    Equal right times are decided by ties, the greatest last. Left rows with a null key or time, or with no
    right row before them, get nulls; right rows with a null key or time match nothing. Every left row stays
    once, repeated ones too. Both sides are laid together and sorted within (keys, slot of width microseconds);
    the last right row of the slots before is carried over, so a hot key is spread over its slots.
    """
    ties = ties or []
    clash = set(take) & set(left.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    usable = lambda at: F.expr(" and ".join(f"`{c}` is not null" for c in (*keys, at)))
    rows = left.withColumn("_us", micros(left_at))
    found = right.where(usable(right_at)).select(*keys, micros(right_at).alias("_us"), F.lit(0).alias("_side"), F.struct(*ties, F.lit(0).alias("_")).alias("_tie"), F.struct(*take).alias("_right"))
    own = rows.where(usable(left_at)).select(*keys, "_us", F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    laid = found.unionByName(own, allowMissingColumns=True).withColumn("_slot", slot(F.col("_us"), width))
    matched = before(laid, keys, "_slot", ["_us", "_side", "_tie"], {"_found": ("last", F.col("_right"))}).where("_side = 1")
    out = matched.select("_left.*", *(F.col(f"_found.{c}").alias(c) for c in take))
    rest = left.where(~usable(left_at)).select(*left.columns, *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take))
    return out.unionByName(rest)


def spaced(requests: DataFrame, keys: list[str], at: str, ties: list[str], delay: int, width: int = DAY) -> DataFrame:
    """The requests (at in microseconds) with start_us: the first time at which no two of a key are closer than delay.

    Requests of a key run in the order of at and ties. Request i starts at the later of its own time and delay
    after the one before, which is i * delay plus the greatest at - j * delay up to it: a count and a running
    maximum, both carried over slots. Rows without a time or a key are left out.
    """
    if delay < 0:
        raise ValueError("the delay can't be negative")
    rows = requests.where(F.expr(" and ".join(f"`{c}` is not null" for c in (*keys, at)))).withColumn("_slot", slot(F.col(at), width))
    order = [at, *ties]
    counted = before(rows, keys, "_slot", order, {"_i": ("sum", F.lit(1).cast("long"))})
    return (
        before(counted, keys, "_slot", order, {"_lead": ("max", F.col(at) - F.col("_i") * delay)}, inclusive=True)
        .withColumn("start_us", F.col("_lead") + F.col("_i") * delay)
        .drop("_slot", "_i", "_lead")
    )
