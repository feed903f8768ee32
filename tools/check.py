"""Run registered queries and their SQL twins side by side: ``python tools/check.py [sf_dir] [name…]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from gaugeframe.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return ("f", v)
    return v


def key(row):
    return tuple((x is None, type(x).__name__, (f"{x[1]:.6f}" if isinstance(x, tuple) else str(x))) for x in row)


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return abs(a[1] - b[1]) <= 1e-9 * max(1.0, abs(a[1]))
    return a == b and type(a) is type(b)


def compare(df, sql, con):
    cols = sorted(df.columns)
    t0 = time.time()
    got = [tuple(canon(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    t1 = time.time()
    if sql is None:
        return f"rows={len(got)} (no sql)", t1 - t0, 0.0
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"COLUMNS differ spark={cols} sql={sorted(names)}", t1 - t0, 0.0
    idx = [names.index(c) for c in cols]
    want = [tuple(canon(r[i]) for i in idx) for r in rel.fetchall()]
    t2 = time.time()
    if len(got) != len(want):
        return f"ROWS differ spark={len(got)} sql={len(want)}", t1 - t0, t2 - t1
    got.sort(key=key)
    want.sort(key=key)
    exact = True
    for g, w in zip(got, want):
        for c, a, b in zip(cols, g, w):
            if not same(a, b):
                return f"VALUES differ at {c}: spark={a!r} sql={b!r}\n   spark row {g}\n   sql row   {w}", t1 - t0, t2 - t1
            exact = exact and a == b
    return f"ok rows={len(got)}" + ("" if exact else " (float noise)") + (" EMPTY" if not got else ""), t1 - t0, t2 - t1


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    from gaugeframe.plans import ORACLES, QUERIES

    names = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bad = 0
    for n in names:
        try:
            msg, ts, tq = compare(QUERIES[n](spark, sf), ORACLES.get(n), con)
        except Exception as e:  # noqa: BLE001
            msg, ts, tq = "ERROR " + str(e).strip()[:900], 0.0, 0.0
        fine = msg.startswith("ok") or msg.startswith("rows=")
        bad += not fine
        print(f"{'  ' if fine else '!!'} {n:34s} {ts:6.2f}s {tq:6.2f}s {msg}", flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
