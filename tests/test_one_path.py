"""The range-split windows give one answer at every size: one range or many, any type."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import joins as J
from quarry.operators import windows as W

VALUES = [1e-12, 3e-12, float("nan"), 1.0, float("inf"), -float("inf"), 1e30, -1e30, None, 2.5, 0.5, 1e-12]


def key(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("split", [dict(), dict(target_rows=2), dict(bucket_seconds=2)])
def test_trailing_sums_of_any_double(spark, split):
    rows = [(k, i * 3, v) for k in (1, 2) for i, v in enumerate(VALUES if k == 1 else VALUES[::-1])] + [(1, None, 7.0), (1, None, None)]
    df = (spark.createDataFrame(rows, "k long, s long, v double")
               .select("k", F.timestamp_seconds("s").alias("ts"), "s", "v"))
    got = sorted(((r.k, r.s if r.s is not None else -1, r.n_trailing, key(r.sum_trailing))
                  for r in W.trailing_range(df, "k", "ts", "v", 7, **split).collect()), key=repr)
    want = []
    for k, s, _ in rows:
        frame = [v for k2, s2, v in rows if k2 == k and (s2 is None if s is None else s2 is not None and s - 7 <= s2 <= s)]
        some = [v for v in frame if v is not None]
        total = sum(some[1:], some[0]) if some else None
        want.append((k, s if s is not None else -1, len(frame), key(total)))
    want.sort(key=repr)
    assert [w[:3] for w in want] == [g[:3] for g in got]
    for w, g in zip(want, got):
        assert w[3] == g[3] or abs(w[3] - g[3]) <= 1e-9 * max(abs(w[3]), 1e-12)


@pytest.mark.parametrize("split", [dict(), dict(buckets=7), dict(target_rows=3)])
def test_ranks_with_text_values_and_ties(spark, split):
    rows = [("a", w, t) for w in ("pear", "fig", "fig", "été", "", None) for t in ("x1", "x10", "yé", "z")]
    df = spark.createDataFrame(rows, "k string, v string, t string")
    got = [(r.v, r.t, r.rn, r.rnk, r.drnk, r.tile) for r in W.rank_spread(df, "k", "v", "t", **split).collect()]
    df.createOrReplaceTempView("ranks_in")
    want = [tuple(r) for r in spark.sql(
        "SELECT v, t, rn, rnk, drnk, tile FROM (SELECT v, t, row_number() OVER (ORDER BY v DESC, t) AS rn, rank() OVER (ORDER BY v DESC) AS rnk, "
        "dense_rank() OVER (ORDER BY v DESC) AS drnk, ntile(4) OVER (ORDER BY v DESC, t) AS tile FROM ranks_in)").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_text_tie_in_a_heavy_instant(spark):
    df = spark.range(60).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") % 2).alias("ts"),
                                F.format_string("t%03d", "id").alias("tie"), F.col("id").alias("v"))
    for split in (dict(), dict(target_rows=5)):
        got = {r.v: (r.prev_v, r.next_v) for r in W.lag_lead(df, "k", "ts", "tie", ["v"], **split).collect()}
        order = [*range(0, 60, 2), *range(1, 60, 2)]
        assert got == {v: (order[i - 1] if i else None, order[i + 1] if i < 59 else None) for i, v in enumerate(order)}


def test_theta_join_refuses_a_large_side(spark):
    big, small = spark.range(10).toDF("x"), spark.range(20_000).toDF("y")
    for how in ("inner", "left"):
        with pytest.raises(ValueError, match="theta_join"):
            J.theta_join(big, small, F.col("x") < F.col("y"), how)
