"""Spark vs DuckDB comparison of registered queries (row count, columns, value multiset)."""

from __future__ import annotations

import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)   # bit-exact
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "item"):
        return norm(v.item())
    return v


_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "boolean": "BOOLEAN", "float": "FLOAT"}


def duck(sf_dir: str):
    import duckdb

    from ..session import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    """Run ``fn(spark, sf_dir)`` and ``sql``; return (ok, message)."""
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return True, f"rows-only {len(rows)}"
    dtypes = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({sql})").fetchall()}
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    if sorted(cols) != sorted(dcols):
        return False, f"columns differ: spark={cols} duckdb={dcols}"
    bad = [(c, t, dtypes.get(c)) for c, t in df.dtypes if _DUCK.get(t, t) != dtypes.get(c)]
    if bad:
        return False, f"types differ: {bad}"
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(norm(r[i]) for i in idx) for r in res.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a, b = sorted(rows, key=key), sorted(drows, key=key)
    if a == b:
        return True, f"OK rows={len(a)}"
    sa, sb = set(a), set(b)
    return False, (f"spark={len(a)} duckdb={len(b)} spark-only={list(sa - sb)[:2]} "
                   f"duckdb-only={list(sb - sa)[:2]}")
