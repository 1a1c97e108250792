"""Run registered jobs on Spark and their oracle SQL on DuckDB; compare results.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [name ...]

Columns are compared by sorted name; rows as an unordered multiset. ``exact`` means
values are equal as printed; ``approx`` means equal after rounding floats to 6 places.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans import registry  # noqa: E402
from quarry.session import get_session  # noqa: E402
from quarry.sources.tables import TABLES  # noqa: E402


def _norm(v, places):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, places) if places is not None else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, places) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, places)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(cols, records, places):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], places) for i in idx) for r in records]
    return sorted(out, key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = get_session("local[8]", 8)
    qs, sqls = registry.queries(), registry.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    names = a.names or list(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, a.sf)
            scols = df.columns
            srecs = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in sqls:
            print(f"{n:28s} rows-only     rows={len(srecs)} spark={ts:.1f}s")
            continue
        try:
            rel = con.sql(sqls[n])
            dcols = rel.columns
            drecs = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{n:28s} DUCK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"{n:28s} COLUMNS spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        if len(srecs) != len(drecs):
            print(f"{n:28s} ROWCOUNT spark={len(srecs)} duck={len(drecs)}")
            bad += 1
            continue
        if _rows(scols, srecs, None) == _rows(dcols, drecs, None):
            verdict = "exact"
        elif _rows(scols, srecs, 6) == _rows(dcols, drecs, 6):
            verdict = "approx"
        else:
            verdict = "VALUES-DIFFER"
            bad += 1
            sr, dr = _rows(scols, srecs, 6), _rows(dcols, drecs, 6)
            diff = [(x, y) for x, y in zip(sr, dr) if x != y][:3]
            print(f"   first diffs (spark, duck) cols={sorted(scols)}: {diff}")
        print(f"{n:28s} {verdict:13s} rows={len(srecs)} spark={ts:.1f}s")
    print(f"checked={len(names)} failing={bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
