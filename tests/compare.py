"""Runs a query and its SQL on the same files and compares the sorted rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str = DATA):
    con = duckdb.connect(config={"threads": 2})
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.5f}" if abs(v) < 1e6 else f"{v:.6g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def both(spark, name, run, sql, folder: str = DATA):
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connection(folder).execute(sql)
    names = [d[0] for d in rel.description]
    want = rows_of(names, rel.fetchall())
    return sorted(df.columns), sorted(names), got, want
