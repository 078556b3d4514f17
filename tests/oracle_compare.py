"""Run registered Spark queries next to their DuckDB oracle SQL and compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of rows
(doubles rounded to 9 significant digits).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

from tagsift.sources.fixtures import TABLES  # noqa: E402


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if not isinstance(v, (list, tuple, dict, np.ndarray)) and not hasattr(v, "asDict"):
        try:
            import pandas as pd
            if pd.isna(v):
                return None
        except (TypeError, ValueError):
            pass
    if isinstance(v, (float, np.floating)):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return float(f"{float(v):.9g}")
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    try:
        if v != v:  # pandas NA / NaT
            return None
    except Exception:
        pass
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def compare_one(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(spdf), oracle=None, ok=None, spark_s=t1 - t0)
    opdf = con.execute(sql).df()
    scols, srows = rows_of(spdf)
    ocols, orows = rows_of(opdf)
    ok = scols == ocols and len(srows) == len(orows) and srows == orows
    info = dict(name=name, rows=len(srows), oracle_rows=len(orows), cols_ok=scols == ocols,
                ok=ok, spark_s=round(t1 - t0, 2))
    if not ok:
        info["spark_cols"], info["oracle_cols"] = scols, ocols
        diff_s = [r for r in srows if r not in set(orows)][:3]
        diff_o = [r for r in orows if r not in set(srows)][:3]
        info["only_spark"], info["only_oracle"] = diff_s, diff_o
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from tagsift.plans import all_oracles, all_queries
    from tagsift.session import build_session
    spark = build_session()
    con = duck_connection(sf_dir)
    qs, ors = all_queries(), all_oracles()
    bad = 0
    for name in (names or sorted(qs)):
        try:
            info = compare_one(spark, con, name, qs[name], ors.get(name), sf_dir)
        except Exception as e:  # report and go on
            info = dict(name=name, ok=False, error=f"{type(e).__name__}: {str(e)[:400]}")
        if info.get("ok") is False:
            bad += 1
        print(info, flush=True)
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
