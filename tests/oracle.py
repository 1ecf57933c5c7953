"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Mirrors the driver's gate: column names sorted, row count, and an
order-insensitive comparison of all values.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, con=None, show: int = 5) -> tuple[bool, str]:
    import __spark_entry__ as E
    df = E.queries()[name](spark, sf_dir)
    s_cols, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = E.oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: rows-only ({len(s_rows)} rows)"
    con = con or duck(sf_dir)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_cols, d_rows = rows_of(d_cols, res.fetchall())
    if s_cols != d_cols:
        return False, f"{name}: columns differ\n spark={s_cols}\n duck ={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"{name}: row count spark={len(s_rows)} duck={len(d_rows)}"
    diffs = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if diffs:
        msg = "\n".join(f"  spark={a}\n  duck ={b}" for a, b in diffs[:show])
        return False, f"{name}: {len(diffs)} differing rows of {len(s_rows)}\n{msg}"
    return True, f"{name}: OK ({len(s_rows)} rows)"


if __name__ == "__main__":
    from strata.session import get_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("local[8]")
    import __spark_entry__ as E
    names = sys.argv[1:] or list(E.queries())
    con = duck(sf)
    bad = 0
    import time
    for n in names:
        t0 = time.time()
        try:
            ok, msg = compare(spark, n, sf, con)
            msg += f" [{time.time() - t0:.1f}s]"
        except Exception as e:  # report and continue
            ok, msg = False, f"{n}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
