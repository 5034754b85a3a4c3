"""Run registered queries in Spark and in DuckDB and compare names, row counts and values.

    python tests/oracle.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _key(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float)) else "n"), v if v is not None else 0) for v in row)


def normal(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 8) + 0.0
    return v


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise the first difference."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    theirs = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    cols = sorted(names)
    ours = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=_key)
    where = [names.index(c) for c in cols]
    theirs = sorted((tuple(normal(r[i]) for i in where) for r in theirs), key=_key)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ on {cols}: {bad[0][0]} != {bad[0][1]}"
    return None if ours else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from tidemark.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, plans, sql = duck(sf_dir), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or plans:
        start = time.time()
        try:
            df = plans[name](spark, sf_dir)
            result = compare(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as exc:  # noqa: BLE001
            result = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad = bool(result) and not result.startswith("rows only")
        failed += bad
        print(f"{'BAD ' if bad else 'ok  '} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
