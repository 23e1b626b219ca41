"""Runs a query and its SQL twin over the same tables and compares names, types and rows."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("LEXITIDE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Spark's type names and DuckDB's.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def connect(data: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    got = con.execute(sql)
    theirs = {c[0]: str(c[1]) for c in got.description}
    ours = dict(df.dtypes)
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} and {sorted(theirs)}"]
    kinds = {k: str(t) for k, t in zip(theirs, con.execute(f"DESCRIBE {sql}").fetchall(), strict=True)}
    bad = [f"{k}: {ours[k]} and {kinds[k]}" for k in ours if TYPES.get(ours[k], "?") not in kinds[k]]
    a = rows_of(df.columns, df.collect())
    b = rows_of(list(theirs), con.execute(sql).fetchall())
    if a != b:
        bad += [f"{sum(a.values())} and {sum(b.values())} rows; only ours {list((a - b).items())[:3]}; only theirs {list((b - a).items())[:3]}"]
    return bad
