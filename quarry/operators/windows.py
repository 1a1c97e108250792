"""Window jobs.

Spark evaluates a window one partition-key group at a time inside one task, so a key
holding a third of all rows would become one huge task. Running totals, lag / lead and ranks
take plain windows for keys of ordinary size and a prefix scan (``scan``) for hot ones.
Trailing ranges and the as-of join window over ``(key, range)`` and stitch the ranges
together with a small per-range summary (one row per key and range).

Those ranges are global cuts of the ordering axis taken from ``approxQuantile``, as
many as the row count needs for about ``TARGET_ROWS`` rows per range. A range holds
that many rows of *all* keys together, so one key's rows inside it are bounded too,
however hot the key is. Results do not depend on where the cuts fall: the stitching
is exact, and the same code runs at every size (an input of one range has no cuts).
Top-n windows use the plain API, whose partial WindowGroupLimit trims every task to n
rows per group before the shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, DateType, NumericType, StringType,
                               TimestampNTZType, TimestampType)

from quarry.operators import scan
from quarry.session import materialize

# Rows per range the sequence operators aim for: one (key, range) window group is
# sorted and buffered by one task, so it must fit an executor comfortably.
TARGET_ROWS = 2_000_000


def micros(df: DataFrame, ts_col: str) -> Column:
    """Epoch microseconds of ``ts_col``: of the instant for a zoned timestamp, of the
    wall-clock time for ``timestamp_ntz``. The latter is assembled from its fields
    (days since the epoch, hour, minute, seconds with fraction), which involve no
    session time zone: a daylight-saving change cannot stretch or fold the axis, and
    naive times compare as SQL compares them (a cast to a zoned timestamp would move
    times inside a skipped hour)."""
    c = F.col(ts_col)
    if isinstance(df.schema[ts_col].dataType, TimestampNTZType):
        return (F.unix_date(c.cast("date")).cast("bigint") * F.lit(86_400_000_000)
                + F.hour(c).cast("bigint") * F.lit(3_600_000_000)
                + F.minute(c).cast("bigint") * F.lit(60_000_000)
                + (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint"))
    return F.unix_micros(c.cast("timestamp"))


def naive_instant(df: DataFrame, ts_col: str) -> Column:
    """``timestamp_ntz`` -> the instant whose UTC wall-clock time it is (a zoned
    timestamp, as watermarks and time windows require), with no session time zone
    involved: windows then align to the naive hours and days, as in SQL."""
    return F.timestamp_micros(micros(df, ts_col))


def naive_of_instant(col: str) -> Column:
    """Inverse of ``naive_instant``: the UTC wall-clock time of an instant as
    ``timestamp_ntz`` (day from the epoch day count, plus the time of day as an
    interval), again without the session time zone."""
    m = F.unix_micros(F.col(col))
    days = F.floor(m / F.lit(86_400_000_000))
    tod = m - days * F.lit(86_400_000_000)
    return (F.date_from_unix_date(days.cast("int")).cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                 (tod / F.lit(1_000_000)).cast("decimal(18, 6)")))


def axis_of(df: DataFrame, col: str) -> Column:
    """A double that never falls as ``col`` rises, for cutting its order into ranges (rows
    of one range are still ordered by ``col`` itself): numbers as they are, times as
    epoch micros, text and binary by their first six bytes, which sort as Spark sorts."""
    c, kind = F.col(col), df.schema[col].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return micros(df, col).cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, (StringType, BinaryType)):
        raw = F.encode(c, "UTF-8") if isinstance(kind, StringType) else c
        return F.conv(F.rpad(F.hex(F.substring(raw, 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, NumericType):
        return c.cast("double")
    raise TypeError(f"no range axis for {kind.simpleString()} column {col!r}")


def _quantiles(df: DataFrame, axis: Column, target_rows: int,
               max_ranges: int | None = None) -> tuple[list[float], int, int]:
    """``(quantiles, rows, null rows)``: the ``k - 1`` inner quantiles of ``axis`` for
    ``k`` ranges of about ``target_rows`` rows (duplicates kept: a value repeated in
    the list holds at least about ``target_rows`` rows on its own), or ``[]`` when
    the data fit one range. One aggregation and one ``approxQuantile`` pass."""
    c = df.select(axis.cast("double").alias("_axis"))
    r = c.agg(F.count(F.lit(1)).alias("n"), F.count("_axis").alias("nn")).first()
    n, nn = int(r["n"]), int(r["nn"])
    k = -(-n // max(1, target_rows))
    if max_ranges:
        k = min(k, max_ranges)
    if k <= 1 or nn == 0:
        return [], n, n - nn
    qs = c.approxQuantile("_axis", [i / k for i in range(1, k)], 1.0 / (2 * k))
    return [q for q in qs if q is not None], n, n - nn


def range_cuts(df: DataFrame, axis: Column, target_rows: int = TARGET_ROWS,
               max_ranges: int | None = None) -> list[float]:
    """Sorted cut points of ``axis`` (a numeric expression) such that each range
    between neighbouring cuts holds about ``target_rows`` rows. One aggregation and
    one distributed ``approxQuantile`` pass; only the cut list reaches the driver.
    Returns ``[]`` (one range) when the data fit one range."""
    return sorted(set(_quantiles(df, axis, target_rows, max_ranges)[0]))


# Range index of rows whose ordering value is null: the smallest index, so they come
# first in ascending order and last in descending order, as Spark orders nulls.
NULL_RANGE = -(2 ** 63)


def range_index(df: DataFrame, axis_col: str, cuts: Sequence[float], out: str = "_b") -> DataFrame:
    """``out`` = index of the range of ``cuts`` holding ``axis_col`` (binary search in
    the JVM via ``Bucketizer``; equal values always share a range; NaN gets the index
    after the last range, null ``NULL_RANGE``). Without cuts every row, null or not,
    gets range 0: one range, no stitching."""
    if not cuts:
        return df.withColumn(out, F.lit(0).cast("bigint"))
    from pyspark.ml.feature import Bucketizer
    splits = [float("-inf"), *cuts, float("inf")]
    tmp = out + "_f"
    b = Bucketizer(splits=splits, inputCol=axis_col, outputCol=tmp, handleInvalid="keep")
    idx = F.when(F.col(axis_col).isNull(), F.lit(NULL_RANGE)).otherwise(F.col(tmp).cast("bigint"))
    return b.transform(df).withColumn(out, idx).drop(tmp)


def join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``cols`` in which nulls match nulls (``eqNullSafe``; Spark still
    plans it as a hash or sort-merge join on the columns), as rows with a null key
    form one group in a window's PARTITION BY. The right side's copies of ``cols``
    are dropped."""
    renamed = [f"_jr{i}" for i in range(len(cols))]
    r = right.select(*[F.col(c).alias(n) for c, n in zip(cols, renamed)],
                     *[c for c in right.columns if c not in cols])
    cond = None
    for c, n in zip(cols, renamed):
        eq = F.col(c).eqNullSafe(F.col(n))
        cond = eq if cond is None else cond & eq
    return left.join(r, cond, how).drop(*renamed)


def with_bucket(df: DataFrame, ts_col: str, bucket_seconds: int | None = None,
                target_rows: int = TARGET_ROWS, cuts: Sequence[float] | None = None,
                tie: str | None = None) -> DataFrame:
    """Adds ``_b``, the time range of each row: fixed ``bucket_seconds`` wide when
    given, else global quantile ranges of about ``target_rows`` rows each (or the
    given ``cuts``, in epoch microseconds, when a caller computed them once for
    several steps). Rows with a null time get ``NULL_RANGE`` (they sort first).

    Quantile ranges cannot separate equal times, so with a ``tie`` column (the
    ordering is ``(ts, tie)``) a time holding about ``target_rows`` rows or more, and
    a mass of null times, gets a range of its own, sub-split by ranges of ``tie``:
    ``_b = range * (tie ranges + 1) + tie range`` keeps the order, and a burst of a
    hot key at one instant is spread over many tasks as well."""
    if bucket_seconds:
        fixed = F.floor(micros(df, ts_col) / (bucket_seconds * 1_000_000))
        return df.withColumn("_b", F.coalesce(fixed, F.lit(NULL_RANGE)))
    heavy, heavy_null = [], False
    if cuts is None:
        raw, _, nulls = _quantiles(df, micros(df, ts_col), target_rows)
        cuts = sorted(set(raw))
        if raw and tie is not None:
            # epoch micros are integers: [v, v + 1) holds exactly the rows at time v
            heavy = sorted(v for v, c in Counter(raw).items() if c > 1)
            heavy_null = nulls > target_rows
            cuts = sorted(set(cuts) | {v + 1 for v in heavy})
    d = df.withColumn("_bm", micros(df, ts_col).cast("double"))
    d = range_index(d, "_bm", cuts).drop("_bm")
    if not heavy and not heavy_null:
        return d
    position = {v: i for i, v in enumerate(cuts)}     # range i + 1 starts at cuts[i]
    heavy_ranges = [position[v] + 1 for v in heavy]
    in_heavy = F.col("_b").isin(heavy_ranges) if heavy else F.lit(False)
    if heavy_null:
        in_heavy = in_heavy | (F.col("_b") == F.lit(NULL_RANGE))
    d = d.withColumn("_hv", in_heavy)
    tie_cuts = range_cuts(d.where("_hv"), axis_of(d, tie), target_rows)
    d = range_index(d.withColumn("_bt", axis_of(d, tie)), "_bt", tie_cuts, out="_s")
    sub = F.when(F.col("_hv") & (F.col("_s") != F.lit(NULL_RANGE)), F.col("_s")).otherwise(F.lit(0))
    width = len(tie_cuts) + 2
    b = (F.when(F.col("_b") == F.lit(NULL_RANGE), F.lit(NULL_RANGE) + sub)
          .otherwise(F.col("_b") * F.lit(width) + sub))
    return d.withColumn("_b", b.cast("bigint")).drop("_bt", "_s", "_hv")


def top_n_per_group(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Top ``n`` rows per group. The ``row_number() <= n`` filter lets Spark insert a
    partial WindowGroupLimit before the shuffle, so each task ships at most ``n`` rows
    per group: a hot group costs ``n * tasks`` rows, not its full size."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def running_total(df: DataFrame, key: str, ts_col: str, tie: str, value: str | Sequence[str],
                  out: str | Sequence[str] = "running", bucket_seconds: int | None = None,
                  target_rows: int = TARGET_ROWS) -> DataFrame:
    """Running sum of ``value`` per ``key`` in ``(ts, tie)`` order (rows frame); several
    columns at once when ``value`` and ``out`` are lists. A plain window for keys of up to
    ``target_rows`` rows, a prefix scan (``scan``) for others; with ``bucket_seconds``, a scan
    over fixed time ranges for all keys."""
    values = [value] if isinstance(value, str) else list(value)
    outs = [out] if isinstance(out, str) else list(out)
    order = [F.col(ts_col), F.col(tie)]
    if bucket_seconds:
        return scan.running_pieces(with_bucket(df, ts_col, bucket_seconds), [key], order, values, outs)
    return scan.running(df, [key], order, values, outs, target_rows)


def lag_lead(df: DataFrame, key: str, ts_col: str, tie: str, cols: Sequence[str],
             bucket_seconds: int | None = None, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``prev_<c>`` / ``next_<c>``: the previous / next row's value per ``key`` in
    ``(ts, tie)`` order. A plain window for keys of up to ``target_rows`` rows, a prefix scan
    (``scan``) for others; with ``bucket_seconds``, a scan over fixed time ranges for all keys."""
    order = [F.col(ts_col), F.col(tie)]
    if bucket_seconds:
        return scan.neighbours(with_bucket(df, ts_col, bucket_seconds), key, order, cols)
    light, hot = scan.split_hot(df, [key], target_rows)
    w = Window.partitionBy(key).orderBy(*order)
    rows = light.select("*", *[F.lag(c).over(w).alias("prev_" + c) for c in cols], *[F.lead(c).over(w).alias("next_" + c) for c in cols])
    if hot is None:
        return rows
    return rows.unionByName(scan.neighbours(scan.ranged(hot, [F.col(key), *order], target_rows), key, order, cols))


def trailing_range(df: DataFrame, key: str, ts_col: str, value: str, width_seconds: int,
                   bucket_seconds: int | None = None, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``n_trailing`` / ``sum_trailing``: rows and sum of ``value`` of the same key with
    ``ts`` in ``[ts - width, ts]`` (a RANGE frame, so equal timestamps are peers; rows
    with a null time are peers of each other).

    Keys of up to ``target_rows`` rows take a plain window. The rows of others are folded to
    one row per ``(key, ts)`` (partial aggregation), and these are cut into time ranges
    (``with_bucket``; with ``bucket_seconds``, fixed ranges for all keys). The frame of a row is
    then the sum of three parts, none of which is a difference, so infinities, NaN and small
    addends among large ones come out as in one frame:

    * the rows of its own range: a RANGE frame inside ``(key, range)``;
    * if the frame begins in an earlier range, the end of that range: running sums from
      the end, looked up at ``ts - width``;
    * the whole ranges between: partial sums of 1, 2, 4, ... ranges (``dyadic``), of which any
      run of ranges needs two per power of two at most.

    No window group is larger than a range, so a hot key or a dense burst is spread over
    many tasks whatever the frame width.
    """
    w_us = int(width_seconds) * 1_000_000
    if not bucket_seconds:
        light, hot = scan.split_hot(df, [key], target_rows)
        frame = Window.partitionBy(key).orderBy("_a").rangeBetween(-w_us, 0)
        rows = (light.withColumn("_a", micros(df, ts_col))
                     .select(*df.columns, F.count(F.lit(1)).over(frame).alias("n_trailing"), F.sum(value).over(frame).alias("sum_trailing")))
        if hot is None:
            return rows
        return rows.unionByName(_trailing_split(hot, key, ts_col, value, w_us, None, target_rows))
    return _trailing_split(df, key, ts_col, value, w_us, bucket_seconds, target_rows)


def dyadic(spans: DataFrame, per_range: DataFrame, key: str, lo: str, hi: str, sums: Sequence[str]) -> DataFrame:
    """``key, lo, hi`` with ``sums`` added up over the ranges ``_x`` of ``per_range`` strictly
    between ``lo`` and ``hi``: a segment tree as a table. Level l holds the sums of blocks of
    2**l ranges; a span takes at most two blocks of each level."""
    longest = spans.agg(F.max(F.col(hi) - F.col(lo)).alias("n")).first()["n"] or 0
    levels = F.sequence(F.lit(0), F.lit(max(0, int(longest).bit_length() - 1)))
    blocks = (per_range.select(key, "_x", *sums, F.explode(levels).alias("_l"))
                       .groupBy(key, "_l", F.expr("shiftright(_x, _l)").alias("_i")).agg(*[F.sum(c).alias(c) for c in sums]))

    def taken(at: Column) -> Column:
        # [first, last) in blocks of this level; an odd border is not covered by the level above
        first = -F.call_function("shiftright", -(F.col(lo) + 1), at)
        last = F.call_function("shiftright", F.col(hi), at)
        some = first < last
        return F.array_compact(F.array(F.when(some & (first.bitwiseAND(1) == 1), F.struct(at.alias("l"), first.alias("i"))),
                                       F.when(some & (last.bitwiseAND(1) == 1), F.struct(at.alias("l"), (last - 1).alias("i")))))
    need = (spans.withColumn("_t", F.explode(F.flatten(F.transform(levels, taken))))
                 .select(key, lo, hi, F.col("_t.l").alias("_l"), F.col("_t.i").alias("_i")))
    return join_on(need, blocks, [key, "_l", "_i"]).groupBy(key, lo, hi).agg(*[F.sum(c).alias(c) for c in sums])


def _trailing_split(df: DataFrame, key: str, ts_col: str, value: str, w_us: int,
                    bucket_seconds: int | None, target_rows: int) -> DataFrame:
    """``trailing_range`` over time ranges."""
    g = (df.groupBy(key, ts_col)
           .agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
           .withColumn("_a", micros(df, ts_col)))
    g = g.withColumn("_lo", F.col("_a") - F.lit(w_us))
    if bucket_seconds:
        for at, out in (("_a", "_b"), ("_lo", "_bl")):
            fixed = F.floor(F.col(at) / (bucket_seconds * 1_000_000))
            g = g.withColumn(out, F.coalesce(fixed, F.lit(NULL_RANGE)))
    else:
        cuts = range_cuts(g, F.col("_a"), target_rows)
        for at, out in (("_a", "_b"), ("_lo", "_bl")):
            g = range_index(g.withColumn("_d", F.col(at).cast("double")), "_d", cuts, out).drop("_d")
    # read by each of the parts below: written once into the shared folder
    g = materialize(g, "trailing-instants")
    own = Window.partitionBy(key, "_b").orderBy("_a").rangeBetween(-w_us, 0)
    here = g.select(key, ts_col, "_a", "_b", "_bl", F.sum("_n").over(own).alias("_n0"),
                    F.sum("_s").over(own).alias("_s0"))
    # the end of the range in which the frame begins
    to_end = (Window.partitionBy(key, "_b").orderBy(F.col("_a").desc())
                    .rowsBetween(Window.unboundedPreceding, 0))
    rest = F.struct(F.sum("_n").over(to_end).alias("n"), F.sum("_s").over(to_end).alias("s"))
    ends = g.select(key, "_b", "_a", F.lit(1).alias("_tag"), F.lit(None).cast("bigint").alias("_ref"),
                    rest.alias("_rest"))
    asks = g.where("_bl < _b").select(
        key, F.col("_bl").alias("_b"), F.col("_lo").alias("_a"), F.lit(0).alias("_tag"),
        F.col("_a").alias("_ref"), F.lit(None).cast(ends.schema["_rest"].dataType).alias("_rest"))
    onward = (Window.partitionBy(key, "_b").orderBy("_a", "_tag")
                    .rowsBetween(0, Window.unboundedFollowing))
    begun = (ends.unionByName(asks)
                 .withColumn("_next", F.first("_rest", ignorenulls=True).over(onward))
                 .where("_tag = 0").select(key, F.col("_ref").alias("_a"), F.col("_next.n").alias("_n1"),
                                           F.col("_next.s").alias("_s1")))
    # the whole ranges between: one row per (key, first range, last range) in use
    per_range = g.groupBy(key, F.col("_b").alias("_x")).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    spans = g.where("_b - _bl > 1").select(key, "_bl", "_b").distinct()
    between = (dyadic(spans, per_range, key, "_bl", "_b", ["_n", "_s"])
               .select(key, "_bl", "_b", F.col("_n").alias("_n2"), F.col("_s").alias("_s2")))
    j = join_on(join_on(here, begun, [key, "_a"], "left"), between, [key, "_bl", "_b"], "left")
    parts = [F.col(f"_s{i}") for i in range(3)]
    zero = F.lit(0).cast(g.schema["_s"].dataType)
    some = F.coalesce(*parts).isNotNull()   # SQL sum: null only without any value
    total = F.coalesce(parts[0], zero) + F.coalesce(parts[1], zero) + F.coalesce(parts[2], zero)
    per_ts = j.select(key, ts_col, (F.col("_n0") + F.coalesce("_n1", F.lit(0)) + F.coalesce("_n2", F.lit(0)))
                      .cast("bigint").alias("n_trailing"), F.when(some, total).alias("sum_trailing"))
    return join_on(df, per_ts, [key, ts_col])


def first_last(df: DataFrame, key: Sequence[str], order: Sequence[Column], col: str,
               nth: int = 2) -> DataFrame:
    """``first_<col>``, ``last_<col>``, ``nth<k>_<col>`` of each group (whole-group frame),
    attached to every row.

    No window over the group is needed: first and last are ``min_by`` / ``max_by``
    aggregates (partial per task), the n-th value comes from a top-n ``row_number``
    whose partial WindowGroupLimit trims every task to n rows per group before the
    shuffle, and the per-group row is joined back (a join AQE can split for a hot
    group). ``order`` must be unique within a group.
    """
    o = F.struct(*order)
    agg = df.groupBy(*key).agg(F.min_by(col, o).alias("first_" + col),
                               F.max_by(col, o).alias("last_" + col))
    w = Window.partitionBy(*key).orderBy(*order)
    nth_rows = (df.select(*key, col, F.row_number().over(w).alias("_rn"))
                  .where(F.col("_rn") <= nth).where(F.col("_rn") == nth)
                  .select(*key, F.col(col).alias(f"nth{nth}_" + col)))
    per_group = join_on(agg, nth_rows, list(key), "left")
    return join_on(df, per_group, list(key))


def rank_spread(df: DataFrame, key: str, value: str, tie: str, tiles: int = 4,
                buckets: int | None = None, target_rows: int = TARGET_ROWS) -> DataFrame:
    """row_number / rank / dense_rank / ntile per ``key`` by ``value`` descending
    (nulls last; ``row_number`` and ``ntile`` break ties by ``tie`` ascending), for groups of
    any size, ties of any size, and any orderable types.

    Keys of up to ``target_rows`` rows take plain windows over one shuffle. The rows of
    others are dealt by range of (key, value, tie) and ranked by a prefix scan
    (``scan.ranks``): no window spans a hot key or a hot tie group. ``buckets`` deals all
    rows into so many pieces."""
    order = [F.col(value).desc(), F.col(tie)]
    if buckets:
        light, hot = None, df
    else:
        light, hot = scan.split_hot(df, [key], target_rows)
    parts = []
    if light is not None:
        w, by_value = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key).orderBy(order[0])
        parts.append(light.select("*", *[f.over(x).cast("bigint").alias(n) for f, x, n in (
            (F.row_number(), w, "rn"), (F.rank(), by_value, "rnk"), (F.dense_rank(), by_value, "drnk"), (F.ntile(tiles), w, "tile"))]))
    if hot is not None:
        pieces = scan.ranged(hot, [F.col(key), *order], target_rows, buckets)
        parts.append(_with_tiles(scan.ranks(pieces, key, value, tie), df.columns, tiles))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _with_tiles(j: DataFrame, columns: Sequence[str], tiles: int) -> DataFrame:
    rn, n, t = F.col("_rn"), F.col("_total"), F.lit(tiles)
    q, r = F.floor(n / t), n % t          # ntile: r tiles of q+1 rows, then tiles of q rows
    big = r * (q + 1)
    tile = F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1) \
            .otherwise(r + F.floor((rn - big - 1) / q) + 1)
    return j.select(*columns, rn.cast("bigint").alias("rn"), F.col("_rank").cast("bigint").alias("rnk"),
                    F.col("_dense").cast("bigint").alias("drnk"), tile.cast("bigint").alias("tile"))
