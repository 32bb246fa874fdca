"""Compare registered queries with their SQL twins: check.py [sf] [name-part ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

from voltloom.catalog import CATALOG
from voltloom.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for r in df.itertuples(index=False, name=None):
        rows.append(tuple("" if v is None or v is pd.NA or v != v else
                          (repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool)
                           else str(v)) for v in r))
    return sorted(rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, float, int]:
    start = time.time()
    mine = CATALOG.builds[name](spark, sf_dir).toPandas()
    took = time.time() - start
    if name not in CATALOG.sqls:
        return ("rows-only" if len(mine) else "EMPTY"), took, len(mine)
    theirs = con.execute(CATALOG.sqls[name]).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"COLUMNS {sorted(mine.columns)} {sorted(theirs.columns)}", took, len(mine)
    a, b = normal(mine), normal(theirs)
    if a == b:
        return ("ok" if a else "ok-EMPTY"), took, len(a)
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"DIFF rows {len(a)} {len(b)}\n   spark {only_a}\n   sql   {only_b}\n   cols {sorted(mine.columns)}", took, len(a)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in CATALOG.builds:
        if parts and not any(p in name for p in parts):
            continue
        try:
            verdict, took, n = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on
            verdict, took, n = f"ERROR {type(e).__name__} {str(e)[:900]}", 0.0, 0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        ok = verdict in ("ok", "rows-only")
        bad += not ok
        print(f"{'  ' if ok else '! '}{name:40s} {took:6.2f}s {n:7d} {verdict}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
