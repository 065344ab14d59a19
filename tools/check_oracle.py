"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

Usage: python tools/check_oracle.py [sf_dir] [key-substring ...]
Prints one line per query: OK / MISMATCH with row counts.
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __import__("os").path.dirname(__import__("os").path.dirname(__file__)))

import duckdb  # noqa: E402

from quarry.plans.registry import load_all  # noqa: E402
from quarry.plans.tables import TABLES  # noqa: E402
from quarry.session import build_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = [tuple(norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return cols, sorted(out, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    filt = [a for a in argv[1:] if not a.startswith("/") and not a.startswith("--")]
    reg = load_all()
    if "--vanilla" in argv:
        # a plain session, as an external caller would create it
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session()
    con = duck(sf_dir)
    bad = 0
    for k, q in reg.items():
        if filt and not any(f in k for f in filt):
            continue
        t0 = time.time()
        try:
            sp = q.build(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SPARK-ERROR {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if q.sql is None:
            print(f"{k:32s} ROWS {len(sp)} (no oracle) spark={t1-t0:.1f}s")
            continue
        try:
            dd = con.execute(q.sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} DUCK-ERROR {str(e)[:400]}")
            bad += 1
            continue
        c1, r1 = rows_of(sp)
        c2, r2 = rows_of(dd)
        ok = c1 == c2 and r1 == r2
        print(f"{k:32s} {'OK' if ok else 'MISMATCH'} rows={len(r1)}/{len(r2)} spark={t1-t0:.1f}s")
        if not ok:
            bad += 1
            if c1 != c2:
                print("   cols", c1, c2)
            else:
                s1, s2 = set(r1), set(r2)
                print("   spark-only", list(s1 - s2)[:3])
                print("   duck-only ", list(s2 - s1)[:3])
    print("FAILED" if bad else "ALL OK", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
