"""Timestamps as whole microseconds, by their own clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR, DAY = 3600 * SECOND, 86_400 * SECOND


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's; one with a zone by the session's clock."""
    return F.expr(f"cast(cast(cast({column} as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as decimal(20, 6)) * 1000000 as bigint)")


def stamp(us: Column) -> Column:
    """The timestamp without a zone of so many microseconds since 1970."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(us / F.lit(SECOND).cast("decimal(10, 0)")).cast("decimal(18, 6)"))


def slot(us: Column, width: int) -> Column:
    """The number of the slot of width microseconds that holds the time; slots before 1970 are negative."""
    return F.floor((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")
