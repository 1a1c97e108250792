"""Streaming behaviour across several micro-batches: state carried between runs of one
checkpoint, late rows, duplicates re-sent across batches, idempotent batch replay."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import rows, same
from conftest import SF_SMALL
from quarry.plans import jobs_streaming, registry
from quarry.session import scratch_path
from quarry.sources.tables import table
from quarry.streaming import streams as S


def _split_events(spark):
    e = table(spark, SF_SMALL, "events")
    mid = e.agg(F.percentile_approx("ts", 0.5)).first()[0]
    return e, e.where(F.col("ts") < F.lit(mid)), e.where(F.col("ts") >= F.lit(mid))


def _run(stream_df, out, ckpt, mode="append", fmt="parquet"):
    q = (stream_df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
         .format(fmt).outputMode(mode).start(out))
    q.awaitTermination()


def test_state_carries_across_runs(spark):
    e, first, second = _split_events(spark)
    src, out, ckpt = (scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    first.write.parquet(f"{src}/b0")
    _run(S.running_totals(S.event_stream(spark, f"{src}/b*", "*.parquet")), out, ckpt)
    second.write.parquet(f"{src}/b1")
    _run(S.running_totals(S.event_stream(spark, f"{src}/b*", "*.parquet")), out, ckpt)
    emitted = spark.read.parquet(out)
    assert emitted.count() > emitted.select("user_id").distinct().count()  # two emissions
    last = emitted.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "n").alias("s")) \
        .select("user_id", "s.n", F.round("s.total", 2).alias("total"))
    want = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"),
                                    F.round(F.sum("value"), 2).alias("total"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_duplicates_resent_in_later_batch(spark):
    e = table(spark, SF_SMALL, "events")
    max_ts = e.agg(F.max("ts")).first()[0]
    src, out, ckpt = (scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    e.write.parquet(f"{src}/b0")
    _run(S.dedup(S.event_stream(spark, f"{src}/b*", "*.parquet"), delay="1 hour"), out, ckpt)
    # re-send the events of the last 30 minutes: inside the 1-hour watermark delay, so
    # only the dedup state (not lateness) can drop them
    recent = e.where(F.col("ts") >= F.lit(max_ts) - F.expr("INTERVAL 30 MINUTES"))
    assert recent.count() > 0
    recent.write.parquet(f"{src}/b1")
    _run(S.dedup(S.event_stream(spark, f"{src}/b*", "*.parquet"), delay="1 hour"), out, ckpt)
    got = spark.read.parquet(out)
    assert got.count() == e.count() == got.select("event_id").distinct().count()


def test_late_rows_dropped_but_on_time_rows_counted(spark):
    e = table(spark, SF_SMALL, "events")
    max_ts = e.agg(F.max("ts")).first()[0]
    src, out, ckpt = (scratch_path(spark, n) for n in ("src", "out", "ckpt"))
    e.write.parquet(f"{src}/b0")
    _run(S.tumbling_counts(S.event_stream(spark, f"{src}/b*", "*.parquet")), out, ckpt)
    before = {(r["window_start"], r["event_type"]): r["n"] for r in spark.read.parquet(out).collect()}
    extra = spark.createDataFrame([
        (10 ** 9, max_ts.replace(minute=0, second=0, microsecond=0).replace(hour=0), 1, "view", 1.0, "{}"),
        (10 ** 9 + 1, max_ts, 1, "view", 1.0, "{}")], S.EVENTS_SCHEMA)
    extra.write.parquet(f"{src}/b1")    # first row: hours behind the watermark; second: on time
    _run(S.tumbling_counts(S.event_stream(spark, f"{src}/b*", "*.parquet")), out, ckpt)
    after = {(r["window_start"], r["event_type"]): r["n"] for r in spark.read.parquet(out).collect()}
    assert after == before   # the late row changed no emitted window; the open one is not emitted


def test_upsert_replay_is_idempotent(spark):
    e = table(spark, SF_SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(spark, "upsert")
    for _ in range(2):  # the same batch id written twice (a retried micro-batch)
        S.latest_per_user(e).write.mode("overwrite").parquet(f"{out}/batch_id=7")
    got = S.compact_latest(spark, out)
    con = duckdb.connect()
    con.register("ev", table(spark, SF_SMALL, "events").toPandas())
    rel = con.sql("""SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM ev) WHERE rn = 1""")
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(rel.columns, rel.fetchall())


WINDOWED = ["stream_tumbling", "stream_sliding", "stream_session", "stream_late", "stream_dedup", "stream_stream_join"]


@pytest.mark.parametrize("name", WINDOWED)
def test_many_micro_batches_over_shuffled_files(spark, duck_small, monkeypatch, name):
    """One file a micro-batch, newest events first: nothing is late in a replay."""
    src, stream = scratch_path(spark, "shuffled"), S.event_stream
    e = table(spark, SF_SMALL, "events")
    mid = F.lit(e.agg(F.percentile_approx("ts", 0.5)).first()[0])
    for part in (e.where(F.col("ts") >= mid), e.where(F.col("ts") < mid)):
        part.repartition(2).write.mode("append").parquet(f"{src}/events.parquet")

    def one_file(spark, folder, glob, **_):
        if folder == src:
            folder, glob = f"{src}/events.parquet", "*.parquet"
        return stream(spark, folder, glob, files_per_batch=1)
    monkeypatch.setattr(S, "event_stream", one_file)
    monkeypatch.setattr(jobs_streaming, "table", lambda spark, sf, t: spark.read.parquet(f"{src}/events.parquet").repartition(3))
    same(registry.queries()[name](spark, src), duck_small.sql(registry.oracle_sql()[name]))


def state_rows(progress):
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in progress]


REPLAYS = {
    "stream_tumbling": lambda stream: S.tumbling_counts(stream()),
    "stream_sliding": lambda stream: S.sliding_counts(stream()),
    "stream_session": lambda stream: S.sessions(stream()),
    "stream_dedup": lambda stream: S.dedup(stream()),
    "stream_stream_join": lambda stream: S.click_then_purchase(stream().where("event_type = 'click'"), stream().where("event_type = 'purchase'")),
    "stream_stateful": lambda stream: S.activity_totals(stream())}


@pytest.mark.parametrize("name", REPLAYS)
def test_state_falls_while_a_replay_runs(spark, duck_small, name):
    """Eight slices, minutes or an hour of delay: the watermark moves from batch to batch, and
    the state never comes near the rows read so far; the result equals the SQL."""
    ev = table(spark, SF_SMALL, "events")
    slices = S.time_slices(ev, rows_per_slice=125)
    assert len(slices) == 8
    ends = [s.agg(F.min("ts"), F.max("ts")).first() for s in slices]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    done = S.replay(REPLAYS[name], [*slices, S.closing_rows(ev, "1 DAY")], "state-" + name)
    marks = [p["eventTime"].get("watermark") for p in done.progress]
    assert len(set(marks)) >= 8 and marks == sorted(marks)
    held, read = state_rows(done.progress), 0
    assert any(b < a for a, b in zip(held, held[1:])), held
    if name != "stream_sliding":   # four windows a row
        assert max(held[3:]) < ev.count() / 2, held
    if name != "stream_stateful":
        got = done.out.where("event_id >= 0") if name == "stream_dedup" else done.out
        same(got, duck_small.sql(registry.oracle_sql()[name]))
    else:
        assert held[-1] <= 1   # only the closing row's user is left


def test_spans_of_activity(spark):
    """A user goes out once the watermark is an hour past its last event, and starts anew;
    the timer moves with every event; ids beyond 53 bits stay exact."""
    big = 2 ** 60 + 1
    minutes = [(big, 0), (big, 50), (big, 100), (7, 10), (9, 170), (9, 200), (big, 300), (7, 330), (7, 331)]
    rows = spark.createDataFrame([(i, u, m, 1.5) for i, (u, m) in enumerate(minutes)], "event_id long, user_id long, m int, value double")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ev = rows.select("event_id", (start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("m"))).alias("ts"), "user_id",
                     F.lit("x").alias("event_type"), "value", F.lit("{}").alias("props"))
    slices = S.time_slices(ev, rows_per_slice=1) + [S.closing_rows(ev, "1 DAY")]
    got = S.replay(lambda stream: S.activity_totals(stream(), idle_minutes=60), slices, "spans").out
    assert sorted(map(tuple, got.collect())) == [(7, 1, 1.5), (7, 2, 3.0), (9, 2, 3.0), (big, 1, 1.5), (big, 3, 4.5)]


def test_slices_of_several_files(spark, duck_small):
    """Each slice is one micro-batch however many files it has."""
    ev = table(spark, SF_SMALL, "events")
    slices = S.time_slices(ev, files_per_slice=3)
    assert len(slices) == S.LEAST_SLICES
    done = S.replay(lambda stream: S.tumbling_counts(stream()), [*slices, S.closing_rows(ev, "1 DAY")], "files", files_per_slice=3)
    assert [p["numInputRows"] for p in done.progress if p["numInputRows"]] == [s.count() for s in slices] + [1]
    same(done.out, duck_small.sql(registry.oracle_sql()["stream_tumbling"]))
