"""Runs queries and their SQL side by side: same columns, same rows in any order."""

from __future__ import annotations

import math
import os


def duck(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        path = os.path.join(sf_dir, f)
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def _key(row):
    return tuple(("nan" if isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)) for v in row)


def differences(spark_df, db, sql: str) -> list[str]:
    """What differs, in words; empty if nothing does."""
    got = spark_df.collect()
    names = spark_df.columns
    want = db.execute(sql)
    want_names = [c[0] for c in want.description]
    out = []
    if sorted(names) != sorted(want_names):
        return [f"columns {sorted(names)} and {sorted(want_names)}"]
    rows = want.fetchall()
    if len(got) != len(rows):
        out.append(f"{len(got)} and {len(rows)} rows")
    order = sorted(names)
    a = sorted(_key([r[c] for c in order]) for r in got)
    at = [want_names.index(c) for c in order]
    b = sorted(_key([r[k] for k in at]) for r in rows)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    return out
