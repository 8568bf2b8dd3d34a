"""Run check queries beside their DuckDB SQL and compare the rows: ``python check.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import tempfile
import time
from decimal import Decimal

import duckdb

from edictal.queries import all_queries
from edictal.session import local_session
from oracles import all_sql

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, (Decimal, float)):
        return round(float(v), 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = [n for a in sys.argv[2:] for n in (__import__(f"edictal.queries.{a[1:]}", fromlist=["QUERIES"]).QUERIES if a[0] == "@" else [a])]
    path = f"/root/testdata/{sf}"
    os.environ.setdefault("SPARK_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="edictal-check-"))
    spark = local_session(8)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    queries, oracles = all_queries(), all_sql()
    bad = 0
    for name in names or queries:
        started = time.time()
        try:
            df = queries[name](spark, path)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - started
            if name not in oracles:
                print(f"{name:32s} rows {len(got):7d}  {took:5.1f}s  (no SQL)", flush=True)
                continue
            cur = db.execute(oracles[name])
            want_cols = [d[0] for d in cur.description]
            want = cur.fetchall()
            a, b = rows(df.columns, got), rows(want_cols, want)
            ok = sorted(df.columns) == sorted(want_cols) and a == b
            print(f"{name:32s} rows {len(got):7d}  {took:5.1f}s  {'ok' if ok else 'MISMATCH'} sql {time.time() - started - took:4.1f}s", flush=True)
            if not ok:
                bad += 1
                print("   columns", sorted(df.columns), sorted(want_cols), len(a), len(b))
                sa, sb = set(map(repr, a)), set(map(repr, b))
                for r in sorted(sa - sb)[:2]:
                    print("   spark ", r[:300])
                for r in sorted(sb - sa)[:2]:
                    print("   duckdb", r[:300])
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"{name:32s} ERROR {type(exc).__name__}: {str(exc)[:400]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
