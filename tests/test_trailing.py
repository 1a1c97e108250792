"""Trailing ranges through the dyadic table."""

import random

from pyspark.sql import functions as F

from quarry.operators import windows as W


def test_dyadic_sums_of_every_span(spark):
    r = random.Random(1)
    held = {x: r.randrange(1, 100) for x in r.sample(range(-20, 45), 40)}   # some ranges are empty
    per = spark.createDataFrame([(1, x, v, float(v)) for x, v in held.items()], "k int, _x long, _n long, _s double")
    spans = [(1, a, b) for a in range(-22, 46) for b in range(a + 2, 47)]
    got = W.dyadic(spark.createDataFrame(spans, "k int, lo long, hi long"), per, "k", "lo", "hi", ["_n", "_s"])
    found = {(g.lo, g.hi): (g["_n"], g["_s"]) for g in got.collect()}
    for _, a, b in spans:
        want = sum(v for x, v in held.items() if a < x < b)
        assert found.get((a, b), (0, 0.0)) == (want, float(want)), (a, b)


def test_a_thousand_ranges(spark):
    """A frame over 500 of 1,000 ranges: the join reads blocks, not ranges."""
    n = 4000
    df = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 7).cast("double").alias("v"))
    out = W.trailing_range(df, "k", "ts", "v", width_seconds=20_000, bucket_seconds=40)
    got = {(r.ts, r.n_trailing, r.sum_trailing) for r in out.collect()}
    plain = {(r.ts, r.n_trailing, r.sum_trailing) for r in W.trailing_range(df, "k", "ts", "v", width_seconds=20_000).collect()}
    assert got == plain and len(got) == n
    spans = spark.range(501, 1000).select(F.lit(1).alias("k"), (F.col("id") - 501).alias("lo"), F.col("id").alias("hi"))
    per = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("_x"), F.lit(1).cast("long").alias("_n"))
    got = W.dyadic(spans, per, "k", "lo", "hi", ["_n"])
    assert {r["_n"] for r in got.collect()} == {500}


def test_a_span_takes_two_blocks_a_level(spark, monkeypatch):
    spans = spark.range(501, 1000).select(F.lit(1).alias("k"), (F.col("id") - 501).alias("lo"), F.col("id").alias("hi"))
    per = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("_x"), F.lit(1).cast("long").alias("_n"))
    joined, join = [], W.join_on
    monkeypatch.setattr(W, "join_on", lambda a, b, c, how="inner": joined.append((a, b)) or join(a, b, c, how))
    W.dyadic(spans, per, "k", "lo", "hi", ["_n"])
    (need, blocks), = joined
    most = need.groupBy("lo").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 9 and blocks.count() <= 2 * 1000 + 20
