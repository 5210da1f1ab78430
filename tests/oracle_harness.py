"""Run a registered Spark query and its DuckDB oracle on the same parquet files and compare.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Compares row count, column names (sorted) and values (order-insensitive),
exactly and with a relative tolerance for floats.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=repr)


def close(a, b, rel=1e-6) -> bool:
    if a == b:
        return True
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and a is not None and b is not None:
        return abs(a - b) <= rel * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple) and len(a) == len(b):
        return all(close(x, y, rel) for x, y in zip(a, b))
    return False


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> dict:
    res = {"rows_spark": len(spark_pdf), "rows_oracle": len(duck_pdf)}
    res["cols_match"] = sorted(spark_pdf.columns) == sorted(duck_pdf.columns)
    if not res["cols_match"]:
        res["cols_spark"] = sorted(spark_pdf.columns)
        res["cols_oracle"] = sorted(duck_pdf.columns)
        return res
    a, b = rows_of(spark_pdf), rows_of(duck_pdf)
    res["exact"] = a == b
    if not res["exact"] and len(a) == len(b):
        bad = [(x, y) for x, y in zip(a, b) if not close(x, y)]
        res["tol_ok"] = not bad
        if bad:
            res["first_diff"] = bad[0]
            res["n_diff"] = len(bad)
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from ragscope.session import get_spark
    spark = get_spark(shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    ok = True
    for name in (names or list(qs)):
        t = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            ok = False
            continue
        ts = time.time() - t
        if name not in sqls:
            print(f"{name:32s} rows-only rows={len(sdf)} spark={ts:.1f}s")
            continue
        try:
            ddf = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:32s} ORACLE ERROR {str(e)[:400]}")
            ok = False
            continue
        r = compare(sdf, ddf)
        good = r.get("exact") or r.get("tol_ok")
        ok &= bool(good)
        print(f"{name:32s} {'OK  ' if good else 'FAIL'} {r} spark={ts:.1f}s")
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
