"""Run registered Spark queries and their DuckDB oracle SQL side by side.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
Compares row count, column names and an order-insensitive hash of values.
"""
from __future__ import annotations

import decimal
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{v:.6g}"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, decimal.Decimal):          # exactly; the number of trailing zeros is not part of the value
        return format(v.normalize() + 0, "f")
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    import duckdb
    from ledgershield.session import build_session
    import __spark_entry__ as E
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    ok = bad = 0
    for k in (keys or list(qs)):
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {k}: {str(e)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"NO-SQL {k}: rows={len(srows)} {ts:.1f}s")
            continue
        try:
            res = con.execute(sqls[k])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL {k}: {str(e)[:600]}")
            bad += 1
            continue
        hs, ls = digest(scols, srows)
        ho, lo = digest(ocols, orows)
        same = sorted(scols) == sorted(ocols) and len(srows) == len(orows) and hs == ho
        if same:
            ok += 1
            print(f"OK {k}: rows={len(srows)} {ts:.1f}s")
        else:
            bad += 1
            print(f"MISMATCH {k}: rows spark={len(srows)} oracle={len(orows)} cols={sorted(scols)} vs {sorted(ocols)}")
            a, b = set(ls), set(lo)
            for x in sorted(a - b)[:3]:
                print("   spark-only:", x[:300])
            for x in sorted(b - a)[:3]:
                print("   oracle-only:", x[:300])
    print(f"== {ok} ok, {bad} bad")


if __name__ == "__main__":
    main()
