"""Repeatable Monte-Carlo estimate of pi (the SparkPi example, made exact).

Points come from an integer linear congruential step over a row id instead of
``rand()``, so any engine computing the same integer arithmetic gets the same count.
All arithmetic is integer: with ``u, v`` in ``[-2^30, 2^30)`` the test
``u^2 + v^2 <= 2^60`` is the unit-disc test and never overflows a bigint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The classic C-library LCG (multiplier, increment, modulus 2^31).
LCG_A = 1103515245
LCG_C = 12345
LCG_M = 2 ** 31
HALF = 2 ** 30
POINTS_PER_SLICE = 100_000  # SparkPi samples 100,000 points per slice


def _lcg(x: Column) -> Column:
    # x is reduced mod 2^31 first, so x * LCG_A < 2^62 and never overflows
    return F.pmod(F.pmod(x, F.lit(LCG_M)) * F.lit(LCG_A) + F.lit(LCG_C), F.lit(LCG_M))


def pi_points(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """``inside int`` per id: 1 when its point lies in the unit disc."""
    x = _lcg(F.col(id_col))
    y = _lcg(x)
    u, v = x - F.lit(HALF), y - F.lit(HALF)
    return ids.select(F.when(u * u + v * v <= F.lit(HALF * HALF), 1).otherwise(0).alias("inside"))


def pi_from_ids(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """``n bigint, inside bigint, pi double`` over the given ids (global aggregate:
    one partial row per task, one final row)."""
    agg = pi_points(ids, id_col).agg(F.count(F.lit(1)).alias("n"),
                                     F.sum("inside").cast("bigint").alias("inside"))
    # try_divide: no points (empty input) gives a null estimate instead of an ANSI error
    return agg.select("n", "inside",
                      F.try_divide(F.lit(4) * F.col("inside").cast("double"), F.col("n")).alias("pi"))


def pi_estimate(spark: SparkSession, slices: int = 100) -> DataFrame:
    """SparkPi: ``100,000 * slices - 1`` points over ids ``1 .. 100,000 * slices - 1``,
    one partition per slice."""
    n = POINTS_PER_SLICE * slices
    return pi_from_ids(spark.range(1, n, numPartitions=slices))
