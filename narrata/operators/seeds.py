"""Seed rows: checks before a load, and the columns a load adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.functions import text

#: Columns that a row's hash leaves out.
UNHASHED = ("RowHash", "ValidFromUtc", "CreatedUtc", "UpdatedUtc")


def unknown_columns(rows: DataFrame, target: DataFrame) -> list[str]:
    return sorted(set(rows.columns) - set(target.columns))


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one current row has."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1").withColumnRenamed("_copies", "copies")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose foreign key no parent has."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def prepare(rows: DataFrame, table: str, natural_key: list[str], guid: str, defaults: dict | None = None) -> DataFrame:
    """Rows with defaults in place of nulls, a deterministic guid, and their hash."""
    for column, value in (defaults or {}).items():
        rows = rows.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in rows.columns else F.lit(value))
    rows = rows.withColumn(guid, text.natural_uuid(table, *(F.col(c) for c in natural_key)))
    return rows.withColumn("RowHash", text.row_hash(rows, (guid, *UNHASHED)))


def load_order(parents: dict[str, set[str]]) -> list[str]:
    """Tables in an order in which each comes after those it refers to (itself aside)."""
    out: list[str] = []

    def put(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"tables refer to each other: {' -> '.join((*path, name))}")
        if name not in out:
            for p in sorted(parents.get(name, set()) - {name}):
                put(p, (*path, name))
            out.append(name)

    for name in sorted(parents):
        put(name, ())
    return out


def without_guid(rows: DataFrame, guid: str, natural_key: list[str]) -> DataFrame:
    """Rows that have no guid and can't be given one, since a part of their natural key is missing."""
    missing = F.lit(not natural_key)
    for column in natural_key:
        missing = missing | F.col(column).isNull()
    return rows.where((F.col(guid).isNull() if guid in rows.columns else F.lit(True)) & missing)


def load(tables: dict[str, DataFrame], keys: dict[str, str], references: dict[str, dict[str, str]]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(loaded, refused) rows of each table, in an order in which a table comes after those it refers to.

    keys names each table's key, references the table that each foreign key column refers to. A row is refused
    if a foreign key (that isn't null) is not among the loaded rows of its table; a reference of a table to
    itself is checked against the table as given.
    """
    out: dict[str, tuple[DataFrame, DataFrame]] = {}
    for name in load_order({t: set(references.get(t, {}).values()) for t in tables}):
        rows = tables[name]
        good = rows
        for column, parent in references.get(name, {}).items():
            known = (rows if parent == name else out[parent][0]).select(F.col(keys[parent]).alias("_known")).distinct()
            good = good.join(known, F.col(column) == F.col("_known"), "left").where(F.col(column).isNull() | F.col("_known").isNotNull()).drop("_known")
        out[name] = good, rows.join(good.select(keys[name]), keys[name], "left_anti")
    return out
