"""Compare registered queries with their SQL on DuckDB, column by column, order-insensitive."""

from __future__ import annotations

import glob
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("SPANFORGE_TESTDATA", "/root/testdata")


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        diff = next((p for p in zip(got, want) if p[0] != p[1]), None)
        return f"rows {len(got)} != {len(want)}; first diff {diff}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{got_cols}\n  spark {a}\n  sql   {b}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from spanforge.session import local_session

    sf = os.environ.get("SF", "0.01")
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark = local_session(shared=tempfile.mkdtemp(prefix="spanforge-oracle-"))
    con = connect(sf_dir)
    oracle = oracle_sql()
    bad = 0
    for name, fn in queries().items():
        if sys.argv[1:] and not any(name.startswith(a) for a in sys.argv[1:]):
            continue
        start = time.time()
        try:
            if name in oracle:
                error = compare(spark, con, name, fn, oracle[name], sf_dir)
            else:
                error = None if fn(spark, sf_dir).count() >= 0 else "negative"
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += error is not None
        mark = "sql" if name in oracle else "rows"
        print(f"{'FAIL' if error else 'ok':4} {mark} {name} {time.time() - start:.2f}s {error or ''}", flush=True)
    print("failures", bad)
