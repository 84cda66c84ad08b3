"""Compare a query with its SQL over the same tables."""

import math
import os
from collections import Counter

import duckdb


def norm(v):
    if v is None or isinstance(v, (bool, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return str(v)


def assert_same(query, sql, spark, folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(map(norm, r)) for r in df.select(*cols).collect())
    said = con.execute(sql)
    names = [d[0] for d in said.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in said.fetchall())
    assert got == want
