"""Compare a query with its SQL in DuckDB."""

import glob
import math
import os
from collections import Counter

import duckdb


def connect(d):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{d}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def same(spark, d, query, sql):
    df = query(spark, d)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = connect(d).sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
