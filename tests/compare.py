"""Runs queries in Spark and their SQL in DuckDB over the same tables and compares rows."""

import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if Path(path).is_dir() else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.9g}")
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, query, sql, sf):
    """None when equal, else what differs."""
    df = query(spark, sf)
    spark_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    duck_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if spark_columns != duck_columns:
        return f"{name}: columns {spark_columns} and {duck_columns}"
    if len(got) != len(want):
        return f"{name}: {len(got)} and {len(want)} rows"
    for a, b in zip(got, want, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{name}: {a} and {b}"
    return None
