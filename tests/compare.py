"""Order-insensitive comparison of a Spark result with DuckDB rows."""

import math


def norm(v, places=6):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, places)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, places) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows(cols, records, places=6):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i], places) for i in idx) for r in records), key=repr)


def same(df, rel):
    s_cols, d_cols = df.columns, rel.columns
    assert sorted(s_cols) == sorted(d_cols)
    s = rows(s_cols, [tuple(r) for r in df.collect()])
    d = rows(d_cols, rel.fetchall())
    assert len(s) == len(d)
    assert s == d
