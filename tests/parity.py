"""Runs registered queries in Spark and their SQL twins in DuckDB and compares rows. Usage: parity.py [sf] [name ...]"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: queries that SQL cannot state, each held against a brute-force version in the tests named
WITHOUT_TWIN = {
    "n1_text_keys": "test_resolution.py", "i6_batch_confirm": "test_identity.py", "p10_detect_cells": "test_graph.py", "g4_expand_three_hops": "test_graph.py",
}


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        if isinstance(v, float) and math.isnan(v):
            return None
        f = float(v)
        return str(int(f)) if f == int(f) else f"{f:.6f}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(cell(x)) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(cell(r[i]) for i in order) for r in rows], key=str)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, folder, name, queries, oracles):
    """(ok, message) of one query."""
    df = queries[name](spark, folder)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return name in WITHOUT_TWIN, f"{len(got)} rows, no twin"
    cur = con.execute(oracles[name])
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b, key=str)[:2]}; only sql {sorted(b - a, key=str)[:2]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    from proofweave.plans.catalog import ORACLES, QUERIES
    from proofweave.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = [n for n in QUERIES if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = duck(folder)
    bad = 0
    spark.sparkContext.setLogLevel("OFF")
    import logging

    logging.disable(logging.CRITICAL)
    for name in names:
        start = time.time()
        try:
            ok, message = compare(spark, con, folder, name, QUERIES, ORACLES)
        except Exception as e:  # report and go on
            ok, message = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print("failures:", bad, "of", len(names))
