"""Side-by-side check of registered queries: Spark result vs the DuckDB oracle, order-insensitive."""

from __future__ import annotations

import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if sql is None:
        return True, f"{len(rows)} rows (no oracle)"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    if sorted(dcols) != cols:
        return False, f"columns {cols} vs {sorted(dcols)}"
    idx = [dcols.index(c) for c in cols]
    drows = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    if rows != drows:
        return False, f"spark {len(rows)} rows vs duckdb {len(drows)}: {list(set(rows) ^ set(drows))[:2]}"
    return True, f"{len(rows)} rows"
