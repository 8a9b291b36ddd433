"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python scripts/check_oracle.py [sf_dir] [name-substring ...]
Prints one line per query: OK / MISMATCH with row counts and columns.
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, ".")
from quotecraft.queries import oracle_sql, queries  # noqa: E402
from quotecraft.session import get_session  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def canon(rows):
    return sorted([tuple(norm(x) for x in r) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    if os.environ.get("PLAIN_SESSION"):
        # the way a caller with no knowledge of this library builds a session
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    else:
        spark = get_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    qs, sq = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            cols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"ERROR-SPARK {name}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sq:
            print(f"NOORACLE {name}: rows={len(srows)} {ts:.1f}s")
            continue
        try:
            res = con.execute(sq[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR-SQL {name}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"COLS {name}: spark={cols} sql={ocols}")
            bad += 1
            continue
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
        a = canon([tuple(r[i] for i in order) for r in srows])
        b = canon([tuple(r[i] for i in oorder) for r in orows])
        if a == b:
            print(f"OK {name}: rows={len(a)} {ts:.1f}s")
        else:
            bad += 1
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            print(f"MISMATCH {name}: spark={len(a)} sql={len(b)} first diffs={diff}")
    print("BAD", bad)


if __name__ == "__main__":
    main()
