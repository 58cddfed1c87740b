"""Spark query against SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compared(spark, query, sql: str, folder: str = DATA) -> tuple[list, list]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = query(spark, folder)
    wanted = con.sql(sql)
    names = sorted(found.columns)
    assert names == sorted(wanted.columns)
    left = sorted(repr(tuple(plain(r[c]) for c in names)) for r in found.collect())
    right = sorted(repr(tuple(plain(r[wanted.columns.index(c)]) for c in names)) for r in wanted.fetchall())
    return left, right
