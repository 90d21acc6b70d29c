"""A query's rows against those of its SQL, as DuckDB gives them."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.5f}"
    return str(v)


def same(df, sql: str, folder: str) -> None:
    got = df.collect()
    c = connect(folder).execute(sql)
    names = [d[0] for d in c.description]
    want = c.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = sorted(tuple(plain(r[n]) for n in order) for r in got)
    b = sorted(tuple(plain(r[names.index(n)]) for n in order) for r in want)
    assert len(a) == len(b)
    assert a == b
