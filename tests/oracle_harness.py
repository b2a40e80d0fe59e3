"""Run registered queries in Spark and their oracle SQL in DuckDB on the same
parquet tables, and compare row count, column names and an order-insensitive
multiset of values (decimals compared as doubles).

    python -m tests.oracle_harness [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def duckdb_con(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_VIEWS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]


def compare(spark, con, sf_dir, name, query, sql, verbose=True):
    t0 = time.time()
    s_cols, s_rows = rows_of_spark(query(spark, sf_dir))
    t1 = time.time()
    d_cols, d_rows = rows_of_duck(con, sql)
    t2 = time.time()
    ok = s_cols == d_cols and Counter(s_rows) == Counter(d_rows)
    if verbose:
        print(f"{'OK ' if ok else 'BAD'} {name}: spark {len(s_rows)} rows {t1 - t0:.1f}s, "
              f"duckdb {len(d_rows)} rows {t2 - t1:.1f}s", flush=True)
        if not ok:
            if s_cols != d_cols:
                print("   cols spark:", s_cols, "\n   cols duck: ", d_cols)
            else:
                cs, cd = Counter(s_rows), Counter(d_rows)
                only_s, only_d = list((cs - cd).elements()), list((cd - cs).elements())
                print(f"   only spark ({len(only_s)}):", sorted(only_s, key=str)[:3])
                print(f"   only duck  ({len(only_d)}):", sorted(only_d, key=str)[:3])
    return ok


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from tallyman.session import local_session

    spark = local_session(8)
    con = duckdb_con(a.sf)
    qs, sqls = e.queries(), e.oracle_sql()
    names = a.names or list(qs)
    bad = []
    for n in names:
        if n not in sqls:
            df = qs[n](spark, a.sf)
            print(f"--- {n}: no oracle, {df.count()} rows")
            continue
        try:
            if not compare(spark, con, a.sf, n, qs[n], sqls[n]):
                bad.append(n)
        except Exception as ex:  # report and go on
            print(f"ERR {n}: {type(ex).__name__}: {str(ex)[:800]}")
            bad.append(n)
    print("FAILED:", bad if bad else "none")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
