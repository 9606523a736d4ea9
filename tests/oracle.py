"""Runs a query and its SQL and compares the rows."""

import math
import os

import duckdb


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        path = os.path.join(sf_dir, f)
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def assert_same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    assert got == rows([d[0] for d in cur.description], cur.fetchall())
