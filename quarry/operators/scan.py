"""Prefix scan over the rows of hot keys.

A window runs each key in one task. That is the best plan for a key of ordinary size, and
none for a key with a third of all rows. The scan splits such keys:

* ``split_hot`` parts the rows of keys with more than ``target_rows`` rows from the others,
  which take a plain window (one shuffle).
* ``ranged`` deals the hot rows once by range of (key, order): a piece holds about
  ``target_rows`` consecutive rows, so a hot key lies in consecutive pieces, and ties are cut
  by the last column of the order. It is written as a table bucketed by piece, so every step
  on (piece, key) reads it without another shuffle.
* Windows inside (key, piece) are the local scans. One row per key and piece (``runs``: at most
  the number of hot keys and pieces together) carries what the key's earlier pieces add up to,
  and is broadcast to the rows if it is small; the rows are never shuffled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quarry.plans.broadcast import small_side
from quarry.session import materialize, scratch_path

MAX_BUCKETS = 100_000   # Spark's own limit of spark.sql.sources.bucketing.maxBuckets
PIECE = "_b"


def _same(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"_hk{i}"))
    return cond


def split_hot(df: DataFrame, keys: Sequence[str], target_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of other keys, rows of keys with more than ``target_rows`` rows or None). Keys
    are counted with partial aggregation; there are at most rows / ``target_rows`` hot ones. A
    null key is a key like any other."""
    if df.count() <= target_rows:
        return df, None
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > target_rows)
    many = materialize(many.select(*[F.col(f"`{k}`").alias(f"_hk{i}") for i, k in enumerate(keys)], F.lit(1).alias("_hot")), "hot-keys")
    if many.isEmpty():
        return df, None
    side = small_side(many)
    return df.join(side, _same(keys), "left_anti"), df.join(side, _same(keys), "left_semi")


def ranged(df: DataFrame, order: Sequence[Column], target_rows: int, pieces: int | None = None) -> DataFrame:
    """``df`` with its piece ``_b`` (rising with ``order``), written once: one shuffle."""
    spark = df.sparkSession
    n = min(MAX_BUCKETS, pieces or max(1, -(-df.count() // max(1, target_rows))))
    path = scratch_path(spark, "scan")
    name = f"quarry_scan_{path.rsplit('-', 1)[-1]}"
    dealt = df.repartitionByRange(n, *order) if n > 1 else df.coalesce(1)
    (dealt.withColumn(PIECE, F.spark_partition_id()).write.bucketBy(n, PIECE).option("path", path).saveAsTable(name))
    return spark.table(name)


def inside(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, PIECE)


def pieces_of(keys: Sequence[str]) -> WindowSpec:
    """The pieces of a key, in order (over ``runs``)."""
    return Window.partitionBy(*keys).orderBy(PIECE)


def earlier(keys: Sequence[str]) -> WindowSpec:
    return pieces_of(keys).rowsBetween(Window.unboundedPreceding, -1)


def carried(local: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``local`` rows with the carry of their key and piece."""
    from quarry.operators.windows import join_on

    return join_on(local, small_side(carry), [*keys, PIECE])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, target_rows: int) -> DataFrame:
    """``out``: position of each row in its key by ``order``, from 1."""
    light, hot = split_hot(df, keys, target_rows)
    rows = light.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    if hot is None:
        return rows
    t = ranged(hot, [*[F.col(k) for k in keys], *order], target_rows)
    runs = t.groupBy(*keys, PIECE).agg(F.count(F.lit(1)).alias("_n"))
    carry = runs.select(*keys, PIECE, F.coalesce(F.sum("_n").over(earlier(keys)), F.lit(0)).alias("_before"))
    local = t.withColumn("_rn", F.row_number().over(inside(keys).orderBy(*order)))
    far = carried(local, carry, keys).select(*df.columns, (F.col("_rn") + F.col("_before")).cast("bigint").alias(out))
    return rows.unionByName(far)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str], outs: Sequence[str],
            target_rows: int) -> DataFrame:
    """Running sums of ``values`` per key (rows frame), null while no value has been seen."""
    light, hot = split_hot(df, keys, target_rows)
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = light.select("*", *[F.sum(v).over(frame).alias(o) for v, o in zip(values, outs, strict=True)])
    if hot is None:
        return rows
    return rows.unionByName(running_pieces(ranged(hot, [*[F.col(k) for k in keys], *order], target_rows), keys, order, values, outs))


def running_pieces(t: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str], outs: Sequence[str]) -> DataFrame:
    """``running`` over rows that have a piece ``_b``."""
    local_frame = inside(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = t.select("*", *[F.sum(v).over(local_frame).alias(f"_local{i}") for i, v in enumerate(values)])
    runs = t.groupBy(*keys, PIECE).agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values)])
    carry = runs.select(*keys, PIECE, *[F.sum(f"_s{i}").over(earlier(keys)).alias(f"_prefix{i}") for i in range(len(values))])

    def total(i: int) -> Column:
        here, before = F.col(f"_local{i}"), F.col(f"_prefix{i}")
        return F.coalesce(here + before, here, before)
    return carried(local, carry, keys).select(*[c for c in t.columns if c != PIECE], *[total(i).alias(o) for i, o in enumerate(outs)])


def neighbours(t: DataFrame, key: str, order: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """``prev_<c>`` and ``next_<c>`` over rows that have a piece ``_b``: the first row of a
    run takes the last row of the key's run before, the last row the first of the run after."""
    w = inside([key]).orderBy(*order)
    row = F.struct(*[F.col(c) for c in cols])
    local = t.select("*", F.lag(row).over(w).alias("_p"), F.lead(row).over(w).alias("_n"),
                     (F.row_number().over(w) == 1).alias("_first"), F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    at = F.struct(*order)
    runs = t.groupBy(key, PIECE).agg(F.min_by(row, at).alias("_bf"), F.max_by(row, at).alias("_bl"))
    wp = pieces_of([key])
    carry = runs.select(key, PIECE, F.lag("_bl").over(wp).alias("_pb"), F.lead("_bf").over(wp).alias("_nb"))
    prev = F.when(F.col("_first"), F.col("_pb")).otherwise(F.col("_p"))
    nxt = F.when(F.col("_last"), F.col("_nb")).otherwise(F.col("_n"))
    return carried(local, carry, [key]).select(*[c for c in t.columns if c != PIECE], *[prev[c].alias("prev_" + c) for c in cols],
                                               *[nxt[c].alias("next_" + c) for c in cols])


def ranks(t: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """``_rn``, ``_rank``, ``_dense``, ``_total`` by ``value`` descending (nulls last), ``tie``
    ascending, over rows that have a piece ``_b``. A value may run on over pieces: its rank
    is that of its first row, and it is one distinct value."""
    by_value = inside([key]).orderBy(F.col(value).desc())
    local = t.select("*", F.row_number().over(inside([key]).orderBy(F.col(value).desc(), F.col(tie))).alias("_rn0"),
                     F.rank().over(by_value).alias("_rk0"), F.dense_rank().over(by_value).alias("_dr0"))
    runs = (t.groupBy(key, PIECE, value).agg(F.count(F.lit(1)).alias("_c")).groupBy(key, PIECE)
             .agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d"), F.max(F.struct(F.col(value).alias("v"))).alias("_f"),
                  F.min(F.struct(F.col(value).alias("v"), "_c")).alias("_l"))
             .select(key, PIECE, "_n", "_d", F.col("_f.v").alias("_fv"), F.col("_l.v").alias("_lv"), F.col("_l._c").alias("_lc")))
    # rows so far of the value a piece ends with: those pieces that end with it are in a row
    same_end = Window.partitionBy(key, "_lv").orderBy(PIECE).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("_end", F.struct(F.col("_lv").alias("v"), F.sum("_lc").over(same_end).alias("n")))
    runs = runs.withColumn("_prev", F.lag("_end").over(pieces_of([key])))
    goes_on = F.col("_prev").isNotNull() & F.col("_prev.v").eqNullSafe(F.col("_fv"))
    runs = runs.withColumn("_tied", F.when(goes_on, F.col("_prev.n")).otherwise(F.lit(0)))
    upto = pieces_of([key]).rowsBetween(Window.unboundedPreceding, 0)
    carry = runs.select(key, PIECE, "_fv", "_tied", F.coalesce(F.sum("_n").over(earlier([key])), F.lit(0)).alias("_rows"),
                        (F.coalesce(F.sum("_d").over(earlier([key])), F.lit(0))
                         - F.sum(F.when(F.col("_tied") > 0, 1).otherwise(0)).over(upto)).alias("_vals"),
                        F.sum("_n").over(Window.partitionBy(key)).alias("_total"))
    tied = (F.col("_tied") > 0) & F.col(value).eqNullSafe(F.col("_fv"))
    return carried(local, carry, [key]).select(
        *[c for c in t.columns if c != PIECE], (F.col("_rn0") + F.col("_rows")).alias("_rn"),
        F.when(tied, F.col("_rows") - F.col("_tied") + 1).otherwise(F.col("_rk0") + F.col("_rows")).alias("_rank"),
        (F.col("_dr0") + F.col("_vals")).alias("_dense"), "_total")
