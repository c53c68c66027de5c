"""Run registered Spark queries and their DuckDB oracles side by side.

Usage: python tools/oracle_check.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive value multiset.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

from gapmeter.catalog import ORACLE, QUERIES  # noqa: E402
from gapmeter.session import build_session  # noqa: E402
from gapmeter.sources.tables import TABLES  # noqa: E402


def norm(v):
    import pandas as pd
    if v is None:
        return None
    if not isinstance(v, (list, tuple)) and not hasattr(v, "tolist") and pd.isna(v):
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        t = str(v)[:19]
        return t[:10] if t.endswith("00:00:00") else t
    return v


def rows(df_pd):
    cols = sorted(df_pd.columns)
    out = []
    for rec in df_pd[cols].itertuples(index=False):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or sorted(QUERIES)
    spark = build_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sp = QUERIES[n](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"SPARK-ERR {n}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in ORACLE:
            print(f"rows-only {n}: {len(sp)} rows ({ts:.1f}s)")
            continue
        try:
            dk = con.execute(ORACLE[n]).df()
        except Exception as e:  # noqa: BLE001
            print(f"DUCK-ERR {n}: {str(e)[:400]}")
            bad += 1
            continue
        c1, r1 = rows(sp)
        c2, r2 = rows(dk)
        if c1 != c2:
            print(f"COLS {n}: spark={c1} duck={c2}")
            bad += 1
        elif len(r1) != len(r2):
            print(f"COUNT {n}: spark={len(r1)} duck={len(r2)}")
            bad += 1
        elif r1 != r2:
            diff = [(a, b) for a, b in zip(r1, r2) if a != b][:3]
            print(f"VALUES {n}: {len(r1)} rows; first diffs {diff}")
            bad += 1
        else:
            print(f"ok {n}: {len(r1)} rows ({ts:.1f}s)")
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
