"""Runs a query and its oracle on the same tables and compares the rows, whatever their order."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations "
    "clicks sales sale_lines clients client_changes vendors items stamps"
).split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        path = path if os.path.isfile(path) else f"{path}/*.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    if type(v).__name__ == "Decimal":
        return float(v)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v


def rows_of(df):
    return sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)


def rows_in_sql(connection, sql):
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=repr)


def check(df, connection, sql):
    names, expected = rows_in_sql(connection, sql)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected
