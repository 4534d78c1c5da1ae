"""Comparing a query with its SQL twin, row by row."""

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def canonical(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, bool):
            return x
        return f"{float(x):.9g}" if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)

    return Counter(tuple(map(one, r)) for r in rows)


def assert_twin(df, con, sql):
    result = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(result.columns)
    order = [result.columns.index(c) for c in columns]
    mine = canonical(tuple(r[c] for c in columns) for r in df.collect())
    theirs = canonical(tuple(r[i] for i in order) for r in result.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
