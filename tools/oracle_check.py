"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Compares column names, coarse types, row count and an order-insensitive
hash of the values (floats to 9 significant digits).
"""

from __future__ import annotations

import argparse
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fleetlens.catalog import load_all  # noqa: E402
from fleetlens.session import TABLES, local_session  # noqa: E402


EXACT = os.environ.get("ORACLE_EXACT") == "1"


def norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if v == int(v) and abs(v) < 1e15:
            return str(int(v))
        return repr(v) if EXACT else f"{v:.9g}"
    if isinstance(v, bool):
        return str(v).lower()
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict(recursive=True))
    import decimal

    if isinstance(v, decimal.Decimal):
        return norm(float(v))
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def coarse(t: str) -> str:
    t = t.lower()
    for k, v in (("int", "int"), ("long", "int"), ("bigint", "int"), ("short", "int"), ("byte", "int"),
                 ("double", "float"), ("float", "float"), ("decimal", "float"), ("string", "str"),
                 ("varchar", "str"), ("bool", "bool"), ("timestamp", "ts"), ("date", "date"),
                 ("array", "list"), ("[]", "list"), ("struct", "struct"), ("map", "map")):
        if k in t:
            return v
    return t


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("--plain", action="store_true", help="a bare local[*] session, as a driver would make")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    reg = load_all()
    names = a.names or sorted(reg)
    if a.plain:
        from pyspark.sql import SparkSession

        spark = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    else:
        spark = local_session()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    bad = 0
    for n in names:
        e = reg[n]
        t0 = time.time()
        try:
            df = e.build(spark, a.sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
            stypes = [coarse(f.dataType.simpleString()) for f in df.schema.fields]
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {n}: spark error {type(ex).__name__}: {str(ex)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        if e.oracle is None:
            print(f"ROWS {n}: {len(srows)} rows ({ts:.1f}s) no oracle")
            continue
        try:
            res = con.execute(e.oracle)
            dcols = [d[0] for d in res.description]
            dtypes = [coarse(str(d[1])) for d in res.description]
            drows = res.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {n}: duckdb error {str(ex)[:800]}")
            bad += 1
            continue
        problems = []
        if sorted(scols) != sorted(dcols):
            problems.append(f"cols spark={scols} duck={dcols}")
        else:
            st = dict(zip(scols, stypes))
            dt = dict(zip(dcols, dtypes))
            tdiff = [(c, st[c], dt[c]) for c in scols if st[c] != dt[c]]
            if tdiff:
                problems.append(f"types {tdiff}")
        if len(srows) != len(drows):
            problems.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not problems or (len(problems) == 1 and problems[0].startswith("types")):
            hs, ls = digest(scols, srows)
            hd, ld = digest(dcols, drows)
            if hs != hd:
                diff_s = sorted(set(ls) - set(ld))[:3]
                diff_d = sorted(set(ld) - set(ls))[:3]
                problems.append(f"values differ; spark-only {diff_s} duck-only {diff_d}")
        if problems:
            bad += 1
            print(f"FAIL {n} ({len(srows)} rows, {ts:.1f}s): " + "; ".join(problems))
        else:
            print(f"OK   {n}: {len(srows)} rows ({ts:.1f}s)")
        if a.show:
            df.show(5, truncate=False)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
