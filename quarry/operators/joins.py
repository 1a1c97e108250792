"""Joins: equi (inner / outer / semi / anti), broadcast, theta, interval and as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.windows import NULL_RANGE, TARGET_ROWS, join_on, micros, with_bucket
from quarry.plans.broadcast import fits, small_side
from quarry.session import materialize


def equi_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Plain equi join. Catalyst/AQE choose broadcast-hash or sort-merge from sizes at
    run time, and AQE splits skewed sort-merge partitions."""
    return left.join(right, on, how)


def dimension_join(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
                   max_rows: int = 100_000) -> DataFrame:
    """Join a fact table to a dimension that is broadcast only after its size is
    checked (``max_rows`` rows and the byte bound of ``small_side``); larger
    dimensions fall back to a shuffle join."""
    return fact.join(small_side(dim, "dimension", max_rows), on, how)


def theta_join(big: DataFrame, small: DataFrame, condition, how: str = "inner",
               max_rows: int = 10_000) -> DataFrame:
    """Non-equi join against a small, size-checked side: a broadcast nested-loop join
    that streams ``big`` once and never shuffles it. A side beyond the bounds is refused:
    without a broadcast Spark would pair all rows with all rows. Join such sides on a
    bucket of their bounds, as ``interval_join`` does."""
    if not fits(small, max_rows):
        raise ValueError(f"theta_join: the small side is over {max_rows} rows or the byte bound")
    return big.join(F.broadcast(small), condition, how)


# Cells the axis of a band join is cut into, as a power of two.
BAND_LEVELS = 20


def band_join(rows: DataFrame, value: str, bands: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows with the bands that hold their value: ``lo <= value < hi`` (inner join; columns
    of the two sides need different names). Both sides may be of any size.

    The axis from the least to the greatest value is cut into 2**``BAND_LEVELS`` cells, and a
    band's cells into blocks of 1, 2, 4, ... cells, at most two of each size. A value looks in
    its one block of each size that some band uses: an equi join on (size, block), then the
    exact test. Blocks of a band do not overlap, so a pair is found once; nothing is paired that
    does not share a block. A null or NaN value and a null bound match nothing; a NaN upper
    bound lies above all values, as Spark orders it."""
    cells = 1 << BAND_LEVELS
    v = F.col(value).cast("double")
    finite = rows.where(F.abs(v) < float("inf")).agg(F.min(v).alias("a"), F.max(v).alias("b")).first()
    low, high = finite["a"] or 0.0, finite["b"] or 0.0

    def cell(x: Column) -> Column:
        # never falls as x rises
        inner = F.floor((x - F.lit(low)) * F.lit(cells / (high - low) if high > low and cells / (high - low) < float("inf") else 0.0))
        return F.when(x <= low, 0).when(x >= high, cells - 1).otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(cells - 1))).cast("bigint")

    def taken(at: Column) -> Column:
        first = -F.call_function("shiftright", -F.col("_lo"), at)
        end = F.call_function("shiftright", F.col("_hi") + 1, at)
        some = first < end
        return F.array_compact(F.array(F.when(some & (first.bitwiseAND(1) == 1), F.struct(at.alias("l"), first.alias("i"))),
                                       F.when(some & (end.bitwiseAND(1) == 1), F.struct(at.alias("l"), (end - 1).alias("i")))))
    left, right = F.col(lo).cast("double"), F.col(hi).cast("double")
    cut = bands.where((left < right) & ~F.isnan(left)).withColumns({"_lo": cell(left), "_hi": cell(right)})
    cut = cut.withColumn("_t", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BAND_LEVELS)), taken))))
    cut = materialize(cut.select(*bands.columns, F.col("_t.l").alias("_l"), F.col("_t.i").alias("_i")), "band-blocks")
    used = [r["_l"] for r in cut.select("_l").distinct().collect()]   # at most BAND_LEVELS + 1
    at = (rows.where(v.isNotNull() & ~F.isnan(v)).withColumn("_c", cell(v))
              .withColumn("_vl", F.explode(F.array(*[F.lit(x) for x in used]).cast("array<int>")))
              .withColumn("_vi", F.expr("shiftright(_c, _vl)")))
    j = at.join(cut, (F.col("_vl") == F.col("_l")) & (F.col("_vi") == F.col("_i")))
    return j.where((F.col(value) >= F.col(lo)) & (F.col(value) < F.col(hi))).select(*rows.columns, *bands.columns)


def interval_join(left: DataFrame, right: DataFrame, key: str, ts: str,
                  width_seconds: int, lower_open: bool = True) -> DataFrame:
    """Pairs ``(l, r)`` with equal ``key`` and ``l.ts < r.ts <= l.ts + width``
    (``<=`` at the lower end when not ``lower_open``). Columns of ``left`` / ``right``
    are prefixed ``l_`` / ``r_``.

    Rows sharing a key and a time are interchangeable here, so candidates are formed
    between distinct ``(key, time)`` instants first (partial aggregation). Instants get
    a time bucket of ``width``; a right instant can only match a left instant of its
    own bucket or the one before, so each left instant is sent to two buckets, and the
    instant pairs come from an equi join on ``(key, bucket)`` plus the exact range
    test. No cross product is formed, a hot key is spread over its buckets, and the
    candidates stay within a small factor of the matching instant pairs even when a
    burst puts many rows at one instant (row-level candidates would pair every row of
    the burst with every other and reject them all). The instant pairs are expanded
    to row pairs by equi joins on ``(key, time)``, where AQE splits a hot instant.
    """
    w = width_seconds * 1_000_000
    valid = F.col(key).isNotNull() & F.col(ts).isNotNull()
    li = left.where(valid).select(F.col(key).alias("_lk"), F.col(ts).alias("_lt")).distinct()
    ri = right.where(valid).select(F.col(key).alias("_rk"), F.col(ts).alias("_rt")).distinct()
    lb = li.withColumn("_lm", micros(li, "_lt")).withColumn(
        "_lb", F.explode(F.array(F.floor(F.col("_lm") / w), F.floor(F.col("_lm") / w) + 1)))
    rb = ri.withColumn("_rm", micros(ri, "_rt")).withColumn("_rb", F.floor(F.col("_rm") / w))
    lower = (F.col("_rm") > F.col("_lm")) if lower_open else (F.col("_rm") >= F.col("_lm"))
    pairs = (lb.join(rb, (F.col("_lk") == F.col("_rk")) & (F.col("_lb") == F.col("_rb")) &
                     (F.col("_rm") <= F.col("_lm") + w) & lower)
               .select("_lk", "_lt", "_rk", "_rt"))
    lf = left.select(*[F.col(c).alias("l_" + c) for c in left.columns])
    rf = right.select(*[F.col(c).alias("r_" + c) for c in right.columns])
    out = (lf.join(pairs, (F.col("l_" + key) == F.col("_lk")) & (F.col("l_" + ts) == F.col("_lt")))
             .join(rf, (F.col("_rk") == F.col("r_" + key)) & (F.col("_rt") == F.col("r_" + ts))))
    return out.drop("_lk", "_lt", "_rk", "_rt")


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, right_cols: Sequence[str],
              bucket_seconds: int | None = None, strict: bool = True,
              target_rows: int = TARGET_ROWS, cuts: Sequence[float] | None = None,
              sql_nulls: bool = True, dedupe: bool = True) -> DataFrame:
    """For every ``left`` row, the latest ``right`` row with the same ``key`` and an
    earlier ``ts`` (``<`` when ``strict``, else ``<=``); right columns come back as
    ``r_<name>`` and are null when there is none. Among right rows sharing the latest
    time, the one with the largest ``right_cols`` values is taken.

    With ``dedupe`` (the default), both sides are first folded to one row per
    ``(key, ts)`` (partial aggregation): every left row of one key and time has the
    same answer, so a burst of a hot key at one instant becomes one lookup, and the
    answers are joined back to the rows (null-safe; AQE splits a hot instant there).
    See ``_asof_core`` for the lookup itself. ``sql_nulls``: right rows with a null
    key or time never match (SQL); otherwise nulls are ordinary values.
    """
    if not dedupe:
        return _asof_core(left, right, key, ts, right_cols, bucket_seconds, strict,
                          target_rows, cuts, sql_nulls)
    if sql_nulls:
        right = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    other = [c for c in right_cols if c not in (key, ts)]
    if other:
        best = F.max(F.struct(*[F.col(c) for c in other])).alias("_rs")
        rr = right.groupBy(key, ts).agg(best).select(key, ts, *[F.col("_rs")[c].alias(c)
                                                                for c in other])
    else:
        rr = right.select(key, ts).distinct()
    lk = left.select(key, ts).distinct()
    ans = _asof_core(lk, rr, key, ts, right_cols, bucket_seconds, strict, target_rows, cuts,
                     sql_nulls)
    return join_on(left, ans, [key, ts], "left")


def _asof_core(left: DataFrame, right: DataFrame, key: str, ts: str, right_cols: Sequence[str],
               bucket_seconds: int | None, strict: bool, target_rows: int,
               cuts: Sequence[float] | None, sql_nulls: bool) -> DataFrame:
    """The as-of lookup.

    Plan: both sides are unioned and cut into ``(key, time range)`` groups (global
    quantile ranges sized from the row count, or fixed ``bucket_seconds`` buckets; see
    ``windows.with_bucket``). Inside a group a running ``last(ignorenulls)`` finds the
    latest right row so far. For rows with none in their own range, a per-range
    summary (one row per key and range) carries the last right row of earlier ranges
    forward; it is joined back on ``(key, range)``. A hot key is thereby spread over
    many tasks, and the result does not depend on where the ranges are cut.

    ``sql_nulls``: right rows with a null key or time never match (SQL equality and
    comparison). Otherwise nulls are ordinary values: a null key is one group, as in
    a window's PARTITION BY, and a null time sorts before every other time.
    """
    if sql_nulls:
        right = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    rc = [F.col(c).alias("r_" + c) for c in right_cols]
    r_type = right.select(F.struct(*rc).alias("s")).schema[0].dataType
    ltypes = {f.name: f.dataType for f in left.schema.fields}
    lside = left.select("*", F.lit(None).cast(r_type).alias("_r"),
                        F.lit(0 if strict else 1).alias("_tag"))
    rside = right.select(*[F.col(c).cast(ltypes[c]).alias(c) if c in (key, ts)
                           else F.lit(None).cast(ltypes[c]).alias(c) for c in left.columns],
                         F.struct(*rc).alias("_r"), F.lit(1 if strict else 0).alias("_tag"))
    both = lside.unionByName(rside)
    both = with_bucket(both.withColumn("_m", micros(both, ts)), ts, bucket_seconds,
                       target_rows, cuts)
    w_local = (Window.partitionBy(key, "_b").orderBy("_m", "_tag")
                     .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w_local))
    summary = (both.groupBy(key, "_b")
                   .agg(F.max_by("_r", F.when(F.col("_r").isNotNull(),
                                             F.coalesce(F.col("_m"), F.lit(NULL_RANGE))))
                         .alias("_bl")))
    w_b = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(key, "_b", F.last("_bl", ignorenulls=True).over(w_b).alias("_carry"))
    out = join_on(local.where(F.col("_tag") == (0 if strict else 1)), carry, [key, "_b"], "left")
    best = F.coalesce(F.col("_last"), F.col("_carry"))
    return out.select(*left.columns, *[best["r_" + c].alias("r_" + c) for c in right_cols])
