"""Rows of a Spark query against rows of SQL on the same tables."""

import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        return "nan" if v != v else math.inf if v == math.inf else float(f"{v:.9g}") if abs(v) < 1e15 else int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def tables(folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def check(df, con, sql):
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    answer = con.execute(sql)
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == names
    want = Counter(tuple(plain(r[columns.index(c)]) for c in names) for r in answer.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
