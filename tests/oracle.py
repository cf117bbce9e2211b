"""Compares queries with their SQL over whole tables, for the tests."""

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _rows(names, data):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in at) for r in data)


def differs(spark, con, query, sql) -> bool:
    df = query(spark, str(DATA))
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    return sorted(names) != sorted(df.columns) or got != _rows(names, res.fetchall())
