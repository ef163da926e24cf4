"""Run a query in Spark and its SQL in DuckDB over the same files and compare rows without order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(float(f"{v:.12g}") + 0.0)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if hasattr(v, "as_tuple"):
        return repr(float(f"{float(v):.12g}") + 0.0)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def both(spark, sf_dir: str, query, sql: str):
    got = query(spark, sf_dir)
    a = rows(got.columns, [tuple(r) for r in got.collect()])
    cur = connect(sf_dir).execute(sql)
    b = rows([d[0] for d in cur.description], cur.fetchall())
    return a, b
