"""Compares a query with its SQL in DuckDB, as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in v.items())
    return v


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    con.execute("SET TimeZone='UTC'")
    want = con.execute(sql)
    columns = sorted(d[0] for d in want.description)
    at = {d[0]: i for i, d in enumerate(want.description)}
    expected = Counter(tuple(_plain(r[at[c]]) for c in columns) for r in want.fetchall())
    df = query(spark, sf_dir)
    assert sorted(df.columns) == columns, (name, df.columns, columns)
    got = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert got == expected, (name, sum(got.values()), sum(expected.values()), list((got - expected).items())[:3], list((expected - got).items())[:3])
    return sum(got.values())
