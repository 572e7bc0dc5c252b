"""Runs a query in Spark and its SQL in DuckDB and compares rows as sorted lists."""

import math
from pathlib import Path

import duckdb


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns, data = duck(sf_dir, sql)
    assert sorted(columns) == sorted(df.columns)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, data)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == b
