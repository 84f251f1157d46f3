"""JSON documents in text columns: typed paths, their shape, and their text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.functions.text import truncate_bytes


def attributes(df: DataFrame, column: str, paths: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a column for each name: the value at its path, of its type; and <column>_fault.

    The text is parsed once, to a variant. A value that isn't there, or can't be read as its type, is null.
    The fault is missing (null text), broken (no JSON) or null; a broken text is kept, with no values.
    """
    parsed = f"_{column}_parsed"
    rows = df.withColumn(parsed, F.try_parse_json(column))
    fault = F.when(F.col(column).isNull(), "missing").when(F.col(parsed).isNull(), "broken")
    found = {name: F.try_variant_get(parsed, path, kind) for name, (path, kind) in paths.items()}
    return rows.withColumns(found | {f"{column}_fault": fault}).drop(parsed)


def shape(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, n, broken, shape): the schema that all JSON texts of a group have together, from a mergeable aggregate."""
    parsed = F.try_parse_json(column)
    return df.groupBy(*by).agg(
        F.count(column).alias("n"), F.count_if(F.col(column).isNotNull() & parsed.isNull()).alias("broken"), F.schema_of_variant_agg(parsed).alias("shape")
    )


def canonical(column: str | Column) -> Column:
    """A JSON text with its objects' keys in order and no white space, null if it isn't JSON; made by Spark alone."""
    return F.to_json(F.try_parse_json(column))


@F.pandas_udf(T.StringType())
def _indented(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), indent=2)
        except ValueError:
            return text

    for texts in batches:
        yield texts.map(one)


def readable(column: str | Column, most_bytes: int | None = None) -> Column:
    """A JSON text laid out by two spaces a level, keys as they come, cut at so many bytes; what isn't JSON stays as it is."""
    text = _indented(column)
    return text if most_bytes is None else truncate_bytes(text, most_bytes)
