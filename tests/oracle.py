"""Runs a query and its SQL and compares their rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("DRIFTLOOM_DATA", "/root/testdata/sf0.001")


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, query, sql, folder, con=None):
    """None if equal, else what differs."""
    df = query(spark, folder)
    got, cols = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or connect(folder)).execute(sql)
    want, wcols = canonical([c[0] for c in cur.description], cur.fetchall())
    if cols != wcols:
        return f"columns {cols} / {wcols}"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {str(bad[0])[:500]}" if bad else None
