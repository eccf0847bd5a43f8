"""Run registered queries against their SQL in DuckDB: python tests/compare.py [sf] [key-prefix ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {Path(f).stem} as select * from '{f}'")
    return con


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(
        ([r[i] for i in order] for r in data),
        key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, fn, sql, sf_dir) -> str:
    df = fn(spark, sf_dir)
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only {len(sr)}"
    cur = con.execute(sql)
    dc, dr = rows_of([c[0] for c in cur.description], cur.fetchall())
    if sc != dc:
        return f"FAIL columns {sc} {dc}"
    if len(sr) != len(dr):
        return f"FAIL rows {len(sr)} {len(dr)}"
    bad = [(a, b) for a, b in zip(sr, dr) if repr(a) != repr(b)]
    if bad:
        a, b = bad[0]
        diff = {c: (x, y) for c, x, y in zip(sc, a, b) if repr(x) != repr(y)}
        return f"FAIL {len(bad)}/{len(sr)} values e.g. {dict(zip(sc, a))} diff {diff}"
    if any(isinstance(v, float) and not math.isfinite(v) for r in sr for v in r):
        return "FAIL non-finite"
    nul = {c for i, c in enumerate(sc) if all(r[i] is None for r in sr)}
    return f"ok {len(sr)}" + (" EMPTY" if not sr else "") + (f" all-null {sorted(nul)}" if nul and sr else "")


def main(argv):
    from tapegrid.plans.session import build_session

    import __spark_entry__ as e
    sf = argv[0] if argv else "0.01"
    want = argv[1:]
    spark = build_session("compare", cores=8, shared=tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    sf_dir = f"{TESTDATA}/sf{sf}"
    con = duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    fails = 0
    for k in qs:
        if want and not any(k.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            res = compare(spark, con, qs[k], sqls.get(k), sf_dir)
        except Exception as ex:  # noqa: BLE001
            res = f"FAIL {type(ex).__name__}: {str(ex)[:400]}"
        fails += res.startswith("FAIL")
        print(f"{k:34s} {time.time() - t:6.2f}s {res}", flush=True)
    print("failures", fails)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
