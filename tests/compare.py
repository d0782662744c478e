"""Rows of a frame against rows of DuckDB on the same tables."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return plain(v.asDict(True))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def ordered(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, con, sql: str) -> None:
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    left, right = ordered(df.collect(), df.columns), ordered(got.fetchall(), columns)
    assert len(left) == len(right)
    assert left == right
