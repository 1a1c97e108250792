"""Compare pandas dtypes of each job's Spark result and its DuckDB oracle (sf0.001).

    python tools/dtype_check.py [name ...]
"""

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans import registry  # noqa: E402
from quarry.session import get_session  # noqa: E402
from quarry.sources.tables import TABLES  # noqa: E402

SF = os.environ.get("SF", "/root/testdata/sf0.001")
spark = get_session("local[8]", 8)
con = duckdb.connect()
for t in TABLES:
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
qs, sqls = registry.queries(), registry.oracle_sql()
bad = 0
for n in (sys.argv[1:] or sorted(sqls)):
    s = qs[n](spark, SF).toPandas()
    d = con.sql(sqls[n]).df()
    sd = {c: str(t) for c, t in s.dtypes.items()}
    dd = {c: str(t) for c, t in d.dtypes.items()}
    diff = {c: (sd.get(c), dd.get(c)) for c in sorted(set(sd) | set(dd)) if sd.get(c) != dd.get(c)}
    if diff:
        bad += 1
        print(f"{n:26s} {diff}")
print("jobs with dtype differences:", bad)
