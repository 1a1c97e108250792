"""Grouped aggregation. Every aggregate here supports partial (map-side) aggregation,
so a key holding a third of the rows is folded to one row per task before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import scan
from quarry.operators.windows import TARGET_ROWS, join_on
from quarry.plans.broadcast import small_side
from quarry.session import materialize


def group_agg(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def distinct_sketches(df: DataFrame, keys: Sequence[str], col: str, lg_k: int = 14) -> DataFrame:
    """``keys, n, sketch``: rows and a HyperLogLog sketch of ``col`` (a relative error of about
    1.6 / sqrt(2 ** lg_k)) per group. Stored by day or file, sketches answer for any set of
    groups later (``merged_distinct``) without reading the rows again."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(col, F.lit(lg_k)).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n, distinct`` of coarser groups than those the sketches were made for."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Sequence[float],
              target_rows: int = TARGET_ROWS) -> DataFrame:
    """Exact, linearly interpolated quantiles of any number of distinct values per group.

    Rows are folded to one row per value with its count (partial aggregation), and counts
    run up over a group's values: in a plain window, or in a prefix scan for groups of more
    than ``target_rows`` values. The value at a position is the least one whose count up to
    and including it exceeds the position: a plain ``min`` per group, for all probabilities
    at once. No hot group, and no map of its values, is held by one task."""
    keys = list(keys)
    kv = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    kv = materialize(kv, "value-counts")
    up = scan.running(kv, keys, [F.col("_v")], ["_n"], ["_upto"], target_rows)
    total = kv.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    up = join_on(up, small_side(total), keys) if keys else up.withColumn("_total", F.lit(total.first()["_total"]).cast("bigint"))

    def at(p: float, end) -> Column:
        place = end(F.lit(float(p)) * (F.col("_total") - 1))
        return F.min(F.when(F.col("_upto") > place, F.col("_v")))
    names = [f"p{int(round(p * 100)):02d}" for p in probs]
    g = up.groupBy(*keys).agg(F.max("_total").alias("_total"), *[at(p, F.floor).alias("_lo_" + n) for p, n in zip(probs, names)],
                              *[at(p, F.ceil).alias("_hi_" + n) for p, n in zip(probs, names)])

    def between(p: float, n: str) -> Column:
        place = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col("_lo_" + n).cast("double"), F.col("_hi_" + n).cast("double")
        return lo + (hi - lo) * (place - F.floor(place))
    found = g.select(*keys, *[between(p, n).alias(n) for p, n in zip(probs, names)])
    # groups without a value have no quantile
    return join_on(df.select(*keys).distinct(), found, keys, "left") if keys else found


def sorted_list(df: DataFrame, keys: Sequence[str], col: str, sep: str = ",", size: int = 1000,
                target_rows: int = TARGET_ROWS) -> DataFrame:
    """Sorted values per key as strings of at most ``size`` values, numbered by ``chunk``: no
    list grows with its group. Values are numbered in a plain window, those of keys with more
    than ``target_rows`` rows in a prefix scan, so no task holds a hot key."""
    rows = scan.numbered(df.select(*keys, col), list(keys), [F.col(col)], "_rn", target_rows)
    chunks = rows.select(*keys, col, ((F.col("_rn") - 1) / size).cast("bigint").alias("chunk"))
    return chunks.groupBy(*keys, "chunk").agg(
        F.array_join(F.sort_array(F.collect_list(col)).cast("array<string>"), sep).alias("items"))


def multi_level(df: DataFrame, kind: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """rollup / cube: Spark expands rows once per grouping set (Expand) and aggregates
    them in one pass; ``gid`` is ``grouping_id()``."""
    g = df.rollup(*keys) if kind == "rollup" else df.cube(*keys)
    return g.agg(*aggs, F.grouping_id().alias("gid"))


def pivot_counts(df: DataFrame, key: str, pivot_col: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``pivot_col`` values as columns. Passing the value list skips the extra
    job that would find the distinct values; missing combinations are 0."""
    p = df.groupBy(key).pivot(pivot_col, list(values)).agg(F.count(F.lit(1)))
    return p.fillna(0, subset=list(values))
