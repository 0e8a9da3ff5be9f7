"""Compare a query with its SQL on the small tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def differences(spark, name: str, query, sql: str, folder: str = DATA) -> tuple[Counter, Counter]:
    """Rows only in Spark's and only in the SQL's result."""
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    df = query(spark, folder)
    cols = sorted(df.columns)
    plain = lambda v: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    a = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = con.sql(sql)
    at = [list(found.columns).index(c) for c in cols]
    b = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    return a - b, b - a
