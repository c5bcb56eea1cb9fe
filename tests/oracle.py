"""Compares a query with its SQL in DuckDB, as sets of rows with repeats."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    ours = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(_norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert ours == theirs
