"""Compares a query with its SQL, rows in any order."""

import collections
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return norm(list(v.values()))
    return v


def same(df, sql, sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = collections.Counter(tuple(norm(v) for v in r) for r in cur.fetchall())
    got = collections.Counter(tuple(norm(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
