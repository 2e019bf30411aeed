"""Run registered queries in Spark and their SQL in DuckDB, compare as multisets.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Values are compared exactly (NaN equal to NaN), column order ignored.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir, verbose=True):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    ok_cols = sorted(scols) == sorted(dcols)
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    ok = ok_cols and a == b
    msg = f"{'OK ' if ok else 'BAD'} {name}: spark {len(srows)} rows ({t1 - t0:.1f}s) duck {len(drows)}"
    if not ok and verbose:
        if not ok_cols:
            msg += f"\n   cols spark={sorted(scols)} duck={sorted(dcols)}"
        else:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            for x, y in diff:
                msg += f"\n   spark {x}\n   duck  {y}"
    print(msg, flush=True)
    return ok


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from adlens.session import get_spark
    import __spark_entry__ as E
    spark = get_spark()
    con = duck(sf_dir)
    qs, sq = E.queries(), E.oracle_sql()
    bad = []
    for n in names or list(qs):
        if n not in sq:
            df = qs[n](spark, sf_dir)
            print(f"R   {n}: {df.count()} rows (no oracle)", flush=True)
            continue
        try:
            if not compare(spark, con, n, qs[n], sq[n], sf_dir):
                bad.append(n)
        except Exception as e:  # noqa: BLE001
            print(f"ERR {n}: {type(e).__name__}: {str(e)[:400]}", flush=True)
            bad.append(n)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()
