"""Stored sketches merged on read; inferred JSON types."""

from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.session import materialize, scratch_path
from quarry.sources import formats


def test_sketches_merge_like_one_scan(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 17).alias("day"), (F.col("id") * 7 % 20_011).alias("x"))
    df = df.unionByName(df.limit(0)).unionByName(spark.createDataFrame([(9, 1, None), (None, 1, 5)], "k long, day long, x long"))
    stored = materialize(A.distinct_sketches(df, ["k", "day"], "x"), "sketches")
    got = {r.k: (r.n, r.distinct) for r in A.merged_distinct(stored, ["k"]).collect()}
    exact = {r.k: (r.n, r.d) for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("x").alias("d")).collect()}
    assert got.keys() == exact.keys() and all(got[k][0] == exact[k][0] for k in got)
    assert all(abs(got[k][1] - exact[k][1]) <= 0.05 * exact[k][1] for k in got)
    once = {r.k: r.e for r in df.groupBy("k").agg(F.hll_sketch_estimate(F.hll_sketch_agg("x", F.lit(14))).alias("e")).collect()}
    assert all(abs(got[k][1] - once[k]) <= 0.02 * max(once[k], 1) for k in got)


def test_times_are_inferred_as_naive(spark):
    path = scratch_path(spark, "json-times")
    df = spark.sql("SELECT 1 AS a, TIMESTAMP_NTZ '2024-03-10 02:30:00.123456' AS t, 'x' AS s, 1.5D AS d")
    formats.write_json(df, path)
    zone, kind = spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.timestampType")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")   # that hour does not exist there
    try:
        back = formats.read_json(spark, path)
        assert dict(back.dtypes) == {"a": "bigint", "t": "timestamp_ntz", "s": "string", "d": "double"}
        assert back.select(F.col("t").cast("string")).first()[0] == "2024-03-10 02:30:00.123456"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert spark.conf.get("spark.sql.timestampType") == kind
