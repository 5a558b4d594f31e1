"""Runs a query's SQL in DuckDB and compares the rows, in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def plain(x):
    return round(x, 6) if isinstance(x, float) and math.isfinite(x) else x


def same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    at = [names.index(c) for c in order]
    b = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want)
    assert a == b
