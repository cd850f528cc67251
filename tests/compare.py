"""Spark rows against another engine's, as unordered rows of columns sorted by name."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else round(v, 9))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def oracle(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
