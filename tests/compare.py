"""Runs queries beside their SQL and compares rows, column by column."""

from __future__ import annotations

import math

import duckdb


def view(d: str):
    import pathlib

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in pathlib.Path(d).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    r = con.execute(sql)
    have = [c[0] for c in r.description]
    names = sorted(have)
    at = [have.index(n) for n in names]
    return names, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
