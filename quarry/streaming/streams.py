"""Structured Streaming jobs over the ``events`` table read as a file stream.

Stored events are replayed in time order (``time_slices``, ``replay``): files that land one
after the other, each a range of time, so that watermarks move and state is dropped between
micro-batches.

Every query runs with ``Trigger.availableNow`` (process what is there, then stop) and
keeps its checkpoint in the shared folder, so a restarted or retried query resumes
from the last committed batch. Sinks are Parquet folders, written either by the file
sink (append) or by ``foreachBatch`` with a batch-id keyed, overwrite-only write
(idempotent on replay).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType,
                               TimestampNTZType, TimestampType)

from quarry.operators.windows import naive_instant, naive_of_instant
from quarry.plans.broadcast import small_side
from quarry.session import scratch_path

EVENTS_SCHEMA = StructType([
    StructField("event_id", LongType()), StructField("ts", TimestampNTZType()),
    StructField("user_id", LongType()), StructField("event_type", StringType()),
    StructField("value", DoubleType()), StructField("props", StringType())])


# Files a micro-batch reads at most, so that a backlog is worked off in batches of bounded
# size instead of one.
FILES_PER_BATCH = 1000


def event_stream(spark: SparkSession, folder: str, glob: str = "events*.parquet",
                 files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    """``events`` as a stream; ``ts`` becomes a zoned timestamp because watermarks
    need one: the instant whose UTC wall-clock time is the stored naive time, so
    windows align to naive hours whatever the session time zone."""
    r = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    df = r.parquet(folder)
    return df.withColumn("ts", naive_instant(df, "ts"))


def _ntz(c: str):
    return naive_of_instant(c)


def run_to_parquet(df: DataFrame, name: str, mode: str = "append") -> str:
    """Run a streaming frame to completion into a Parquet folder; return the folder.

    append: the file sink (exactly-once through its commit log).
    complete / update: ``foreachBatch`` overwriting the folder with each batch's full
    result, which a replayed batch simply rewrites.
    """
    spark = df.sparkSession
    out, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-ckpt")
    w = df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").outputMode("append").start(out)
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(out)
        q = w.outputMode(mode).foreachBatch(write).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return out


def stateless(events: DataFrame) -> DataFrame:
    return (events.where(F.col("event_type").isin("purchase", "error"))
                  .select("event_id", "user_id", _ntz("ts").alias("ts"), "event_type", "value"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    g = (events.withWatermark("ts", delay)
               .groupBy(F.window("ts", width), "event_type")
               .agg(F.count(F.lit(1)).alias("n")))
    return g.select(_ntz("window.start").alias("window_start"), "event_type", "n")


def sliding_counts(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes",
                   delay: str = "10 minutes") -> DataFrame:
    g = (events.withWatermark("ts", delay)
               .groupBy(F.window("ts", width, slide), "event_type")
               .agg(F.count(F.lit(1)).alias("n")))
    return g.select(_ntz("window.start").alias("window_start"), "event_type", "n")


SESSION_LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions per user (``gap`` of inactivity closes one). Rows are merged into
    sessions inside each map partition before the shuffle (the session-window form of
    partial aggregation), so a hot user's rows of a micro-batch do not all cross the
    network; the setting is switched on here for sessions built on any session, and
    a query takes it when it starts."""
    events.sparkSession.conf.set(SESSION_LOCAL_MERGE, "true")
    g = (events.withWatermark("ts", delay)
               .groupBy("user_id", F.session_window("ts", gap))
               .agg(F.count(F.lit(1)).alias("n")))
    return g.select("user_id", _ntz("session_window.start").alias("session_start"),
                    _ntz("session_window.end").alias("session_end"), "n")


def dedup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per ``event_id`` while duplicates arrive within ``delay`` of each other;
    state for a key is dropped once the watermark passes it."""
    return (events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
                  .select("event_id", "user_id", _ntz("ts").alias("ts"), "event_type"))


def static_join(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Stream-static join. AQE does not run inside micro-batches, so the static side is
    broadcast only after a row-count check; above the bound every batch shuffles both
    sides (on a cluster, a table bucketed by the key avoids re-shuffling it)."""
    c = small_side(customers.select(F.col("c_custkey").alias("user_id"), "c_mktsegment",
                                    "c_nationkey"), "static side", 1_000_000)
    return (events.join(c, "user_id", "left")
                  .select("event_id", "user_id", _ntz("ts").alias("ts"), "c_mktsegment",
                          "c_nationkey"))


def click_then_purchase(clicks: DataFrame, purchases: DataFrame, within_minutes: int = 30,
                        delay: str = "1 hour") -> DataFrame:
    """Stream-stream inner join: a click and a purchase of the same user with the
    purchase after the click, within ``within_minutes``. The time bound plus the
    watermarks let Spark drop join state older than the bound.

    The join key is (user, time bucket) with buckets as wide as the bound: a purchase can
    only match a click of its own bucket or the one before, so each click goes to two
    buckets, and a hot user's rows and state are spread over partitions."""
    width = within_minutes * 60_000_000
    c = clicks.withWatermark("ts", delay).select(
        F.col("event_id").alias("click_id"), F.col("user_id").alias("c_user"),
        F.col("ts").alias("click_ts"), F.floor(F.unix_micros("ts") / width).alias("_b"))
    c = c.select("click_id", "c_user", "click_ts", F.explode(F.array(F.col("_b"), F.col("_b") + 1)).alias("c_bucket"))
    p = purchases.withWatermark("ts", delay).select(
        F.col("event_id").alias("purchase_id"), F.col("user_id").alias("p_user"),
        F.col("ts").alias("purchase_ts"), F.floor(F.unix_micros("ts") / width).alias("p_bucket"))
    cond = ((F.col("c_user") == F.col("p_user")) & (F.col("c_bucket") == F.col("p_bucket")) &
            (F.col("purchase_ts") > F.col("click_ts")) &
            (F.col("purchase_ts") <= F.col("click_ts") + F.expr(f"INTERVAL {within_minutes} MINUTES")))
    return c.join(p, cond).select("click_id", "purchase_id", F.col("c_user").alias("user_id"),
                                  _ntz("click_ts").alias("click_ts"),
                                  _ntz("purchase_ts").alias("purchase_ts"))


RUNNING_OUT = StructType([StructField("user_id", LongType()), StructField("n", LongType()),
                          StructField("total", DoubleType())])
RUNNING_STATE = StructType([StructField("n", LongType()), StructField("total", DoubleType())])


def _running(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for b in batches:
        n += int(b["n"].sum())
        total += float(b["total"].sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


PARTIAL = StructType([StructField("user_id", LongType()), StructField("n", LongType()),
                      StructField("total", DoubleType())])


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per Arrow batch: one ``(user_id, n, total)`` row per user in the batch. Grouped by
    Arrow, which keeps 64-bit ids exact beside nulls (a null user is one group)."""
    for b in batches:
        rows = pa.Table.from_batches([b])
        ones = pa.array(np.ones(b.num_rows, dtype=np.int64))
        value = pa.compute.coalesce(rows["value"], pa.scalar(0.0))
        t = pa.table({"user_id": rows["user_id"], "n": ones, "total": value})
        g = t.group_by("user_id").aggregate([("n", "sum"), ("total", "sum")])
        yield from g.select(["user_id", "n_sum", "total_sum"]).rename_columns(["user_id", "n", "total"]).to_batches()


def running_totals(events: DataFrame) -> DataFrame:
    """Custom per-user state (count and sum of ``value``) kept across micro-batches
    with ``applyInPandasWithState``; each batch emits the updated totals.

    The state operator hands all of a user's rows in a micro-batch to one call, so rows
    are first folded inside every Arrow batch (``mapInArrow``: stateless, no shuffle)
    to one partial ``(n, total)`` per user; the state function adds the partials. A
    user with a third of all events then costs one row per batch, not all its rows.
    """
    partial = events.select("user_id", "value").mapInArrow(_fold_batches, PARTIAL)
    return (partial.groupBy("user_id")
                   .applyInPandasWithState(_running, RUNNING_OUT, RUNNING_STATE, "append",
                                           GroupStateTimeout.NoTimeout))


SPAN_IN = StructType([StructField("user_id", LongType()), StructField("n", LongType()), StructField("total", DoubleType()),
                      StructField("last", TimestampType())])
SPAN_STATE = StructType([StructField("n", LongType()), StructField("total", DoubleType()), StructField("ends_ms", LongType())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ActivitySpans(StatefulProcessor):
    """Per user, count and sum of the events of the current span of activity: one value
    state, and one event-time timer ``idle_ms`` after the user's last event. When the timer
    fires the span's totals go out and the user leaves the state."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", SPAN_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total, ends = self.span.get() if self.span.exists() else (0, 0.0, None)
        until = ends or 0
        for b in rows:
            n += int(b["n"].sum())
            total += float(b["total"].sum())
            until = max(until, int(b["last"].max().timestamp() * 1000) + self.idle_ms)
        if until != ends:
            if ends is not None:
                self.handle.deleteTimer(ends)
            self.handle.registerTimer(until)
        self.span.update((n, total, until))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, total, _ = self.span.get()
        self.span.clear()
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def _fold_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per Arrow batch: one ``(user_id, n, total, last)`` row per user in the batch."""
    for b in batches:
        rows = pa.Table.from_batches([b])
        t = rows.append_column("n", pa.array(np.ones(b.num_rows, dtype=np.int64))).set_column(
            rows.schema.get_field_index("value"), "value", pa.compute.coalesce(rows["value"], pa.scalar(0.0)))
        g = t.group_by("user_id").aggregate([("n", "sum"), ("value", "sum"), ("ts", "max")])
        yield from g.select(["user_id", "n_sum", "value_sum", "ts_max"]).rename_columns([f.name for f in SPAN_IN]).to_batches()


def activity_totals(events: DataFrame, idle_minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """``user_id``, ``n``, ``total`` of every span of activity, once the watermark is
    ``idle_minutes`` past the user's last event (``transformWithStateInPandas``: value state,
    event-time timers, RocksDB). The state holds active users only; a user's spans add up to
    all of its events. (A pause the watermark never fell into does not part two spans.)

    A user's rows of a micro-batch are folded inside every Arrow batch first, so a hot user
    costs one row per Arrow batch. Rows without a time or a user are left out."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.where("ts IS NOT NULL AND user_id IS NOT NULL").select("user_id", "value", "ts")
    folded = rows.mapInArrow(_fold_spans, SPAN_IN).withWatermark("last", delay)
    return folded.groupBy("user_id").transformWithStateInPandas(
        ActivitySpans(idle_minutes * 60_000), RUNNING_OUT, "Append", "EventTime")


def closing_rows(events: DataFrame, after: str) -> DataFrame:
    """One row without type, of user -1, ``after`` the last event: landed last, it moves the
    watermark past every open window; its own never closes."""
    last = events.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts"))
    return last.select(F.lit(None).cast("bigint").alias("event_id"), "ts", F.lit(-1).cast("bigint").alias("user_id"),
                       F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"),
                       F.lit(None).cast("string").alias("props"))


# Rows a slice of a replay holds at most (one file, one micro-batch), and slices at least.
ROWS_PER_SLICE, LEAST_SLICES = 5_000_000, 3


def time_slices(events: DataFrame, by: Column | None = None, rows_per_slice: int = ROWS_PER_SLICE,
                files_per_slice: int = 1) -> list[DataFrame]:
    """``events`` cut into ranges of ``by`` (the time they arrive; ``ts`` unless given), in
    order: written once by one range exchange, each slice a folder of its own."""
    spark = events.sparkSession
    n = max(LEAST_SLICES, -(-events.count() // rows_per_slice))
    staged = scratch_path(spark, "slices")
    (events.repartitionByRange(n * files_per_slice, F.col("ts") if by is None else by)
           .withColumn("slice", F.floor(F.spark_partition_id() / files_per_slice))
           .write.partitionBy("slice").parquet(staged))
    written = spark.read.schema(StructType([*events.schema.fields, StructField("slice", LongType())])).parquet(staged)
    found = sorted(r.slice for r in written.select("slice").distinct().collect())
    return [written.where(F.col("slice") == i).drop("slice") for i in found] or [events.limit(0)]


class Replay(NamedTuple):
    """The sink of a replay, and the progress reports of its micro-batches."""

    out: DataFrame
    progress: list


def replay(make: Callable[[Callable[[], DataFrame]], DataFrame], slices: list[DataFrame], name: str,
           files_per_slice: int = 1) -> Replay:
    """Let ``slices`` land one after the other and run ``make(stream)`` over them, one slice a
    micro-batch, with one checkpoint and one append sink. ``stream()`` opens the source.

    The file source reads files in the order they landed. With one file per slice, one query
    takes one file a micro-batch; slices of several files get a run of the query each, so a
    micro-batch never holds a part of a slice (the rest of it would come late)."""
    spark = slices[0].sparkSession
    src, out, ckpt = (scratch_path(spark, name + x) for x in ("-src", "", "-ckpt"))
    schema = None

    def run(files: int | None) -> list:
        nonlocal schema
        df = make(lambda: event_stream(spark, f"{src}/b*", glob="*.parquet", files_per_batch=files))
        schema = df.schema
        q = (df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
               .format("parquet").outputMode("append").start(out))
        q.awaitTermination()
        if q.exception():
            raise q.exception()
        return list(q.recentProgress)
    progress = []
    for i, part in enumerate(slices):
        (part.coalesce(1) if files_per_slice == 1 else part).write.parquet(f"{src}/b{i:06d}")
        if files_per_slice > 1:
            progress += run(None)
    if files_per_slice == 1:
        progress += run(1)
    return Replay(spark.read.schema(schema).parquet(out), progress)


def upsert_batches(df: DataFrame, out: str, ckpt: str,
                   prepare: Callable[[DataFrame], DataFrame], mode: str = "append") -> None:
    """Write each micro-batch into ``out/batch_id=<id>`` with overwrite of that folder
    only: a replayed batch replaces its own earlier attempt, so the sink is idempotent."""
    def write(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    q = (df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
           .outputMode(mode).foreachBatch(write).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def latest_per_user(batch: DataFrame) -> DataFrame:
    """Latest event per user inside one batch (max_by aggregates partially)."""
    order = F.struct(F.col("ts"), F.col("event_id"))
    row = F.struct("event_id", _ntz("ts").alias("ts"), "event_type")
    return batch.groupBy("user_id").agg(F.max_by(row, order).alias("last"))


def compact_latest(spark: SparkSession, out: str) -> DataFrame:
    """Read side of the upsert log: latest row per user over all batches."""
    logged = spark.read.parquet(out)
    order = F.struct(F.col("last.ts"), F.col("last.event_id"))
    best = logged.groupBy("user_id").agg(F.max_by("last", order).alias("last"))
    return best.select("user_id", F.col("last.event_id").alias("event_id"),
                       F.col("last.ts").alias("ts"), F.col("last.event_type").alias("event_type"))
