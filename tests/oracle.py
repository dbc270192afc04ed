"""Runs a query and its SQL in DuckDB over the same tables and compares the rows as sets with counts."""
from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def both(spark, query, sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)
    return ours, theirs
