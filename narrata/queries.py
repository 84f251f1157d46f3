"""The library's queries and their oracle SQL, without the training-data subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from narrata.plans import ask, corpus, lessons, shop, views  # noqa: F401 (shop registers its queries with corpus)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: (lambda spark, d, n=n: views.Views(spark, d)[n]) for n in views.all_views()}
    out |= {n: (lambda spark, d, a=a: ask.plan(a, views.Views(spark, d))) for n, a in lessons.LESSONS.items()}
    return out | corpus.queries()


def oracle_sql() -> dict[str, str]:
    out = {n: views.with_ctes(f"SELECT * FROM {{{n}}}") for n in views.all_views()}
    out |= {n: views.with_ctes(ask.sql(a)) for n, a in lessons.LESSONS.items()}
    return out | corpus.oracle_sql()
