"""Compare registered queries with their SQL on DuckDB: python tools/check.py [folder] [name-part ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(value) -> str:
    return type(value).__name__


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def compare(names_a, rows_a, names_b, rows_b) -> str:
    if sorted(names_a) != sorted(names_b):
        return f"columns {sorted(names_a)} / {sorted(names_b)}"
    order_a = sorted(range(len(names_a)), key=lambda i: names_a[i])
    order_b = sorted(range(len(names_b)), key=lambda i: names_b[i])
    left = sorted(tuple(canon(r[i]) for i in order_a) for r in rows_a)
    right = sorted(tuple(canon(r[i]) for i in order_b) for r in rows_b)
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"values\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}"
    return ""


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    parts = sys.argv[2:]
    from rewardloom.catalog import QUERIES, SQL
    from rewardloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if name not in SQL:
                print(f"rows  {name}: {len(rows)} rows, {t1 - t0:.1f}s (no SQL)", flush=True)
                continue
            cur = con.execute(SQL[name])
            expected = cur.fetchall()
            problem = compare(df.columns, rows, [d[0] for d in cur.description], expected)
        except Exception as error:  # noqa: BLE001
            problem = f"error {type(error).__name__}: {str(error)[:400]}"
            rows, t1 = [], time.time()
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok   '} {name}: {len(rows)} rows, {t1 - t0:.1f}s {problem}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
