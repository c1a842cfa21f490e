"""Compare a query with its SQL in DuckDB as the driver does: rows without order, columns by name."""

import os

import duckdb


def shown(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{shown(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return repr(v)


def tables(folder):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t[:-8]} as select * from '{folder}/{t}'")
    return con


def assert_same(spark, folder, query, sql):
    df = query(spark, folder)
    columns = sorted(df.columns)
    ours = sorted([shown(r[c]) for c in columns] for r in df.collect())
    found = tables(folder).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted([shown(x[i]) for i in at] for x in found.fetchall())
