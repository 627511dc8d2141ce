"""A query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.date) and not isinstance(x, datetime.datetime):
        return datetime.datetime(x.year, x.month, x.day)
    return x


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    out = con.sql(sql)
    order = sorted(range(len(out.columns)), key=lambda i: out.columns[i])
    return [out.columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in out.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
