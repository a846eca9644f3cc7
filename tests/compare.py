"""Runs queries against their SQL in DuckDB and tells where rows differ."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


def differences(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=key)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)
    if a != b:
        first = next((p for p in zip(a, b) if p[0] != p[1]), None)
        return f"{len(a)} and {len(b)} rows, first difference {first}"
    return ""
