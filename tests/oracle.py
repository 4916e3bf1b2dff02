"""Comparison of a query with its DuckDB SQL."""

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        f = Path(sf_dir, f"{t}.parquet")
        if f.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def same(df, sql: str, sf_dir: str) -> None:
    names, rows = rows_of(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=key)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b
