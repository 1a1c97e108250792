"""Streaming jobs: each runs a Structured Streaming query over ``events`` to completion
(``availableNow``), then returns a batch read of its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.registry import job
from quarry.session import scratch_path
from quarry.sources.tables import table
from quarry.streaming import streams as S


def _events(spark, sf):
    return S.event_stream(spark, sf, glob="events.parquet")


def _replayed(spark, sf, make, name, closing=False):
    """Sink of a replay of the events in time order; with ``closing``, a row a day behind
    the last event closes what is open."""
    ev = table(spark, sf, "events")
    slices = S.time_slices(ev) + ([S.closing_rows(ev, "1 DAY")] if closing else [])
    return S.replay(make, slices, name).out


@job("stream_stateless", sql="""
  SELECT event_id, user_id, ts, event_type, value FROM events
  WHERE event_type IN ('purchase', 'error')
""")
def q_stream_stateless(spark, sf):
    out = S.run_to_parquet(S.stateless(_events(spark, sf)), "stream-stateless")
    return spark.read.parquet(out)


@job("stream_tumbling", sql="""
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n
  FROM events GROUP BY 1, 2
""")
def q_stream_tumbling(spark, sf):
    return _replayed(spark, sf, lambda stream: S.tumbling_counts(stream()), "stream-tumbling", closing=True)


@job("stream_sliding", sql="""
  SELECT window_start, event_type, count(*) AS n FROM (
    SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS window_start
    FROM events, range(4) AS r(k))
  GROUP BY 1, 2
""")
def q_stream_sliding(spark, sf):
    return _replayed(spark, sf, lambda stream: S.sliding_counts(stream()), "stream-sliding", closing=True)


_SESSIONS_SQL = """
  WITH e AS (
    SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL
                              OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts
                                          ROWS UNBOUNDED PRECEDING) AS sid FROM e)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
         count(*) AS n
  FROM s GROUP BY user_id, sid
"""


@job("stream_session", sql=_SESSIONS_SQL)
def q_stream_session(spark, sf):
    return _replayed(spark, sf, lambda stream: S.sessions(stream()), "stream-session", closing=True)


@job("stream_late", sql="""
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n
  FROM events GROUP BY 1, 2
""")
def q_stream_late(spark, sf):
    """Hourly counts, one output row per window. After the last slice of time, all events
    older than a day before it come again: they are behind the watermark (Spark judges
    lateness by that of the micro-batch before) and change nothing. A closing row lets the
    windows still open go out."""
    ev = table(spark, sf, "events")
    slices = S.time_slices(ev)
    old = F.col("ts") < F.lit(slices[-1].agg(F.min("ts")).first()[0]) - F.expr("INTERVAL 1 DAY")
    again = ev.where(old).withColumn("event_id", F.col("event_id") + F.lit(10 ** 12))
    return S.replay(lambda stream: S.tumbling_counts(stream()), [*slices, again, S.closing_rows(ev, "1 DAY")], "stream-late").out


@job("stream_dedup", sql="SELECT event_id, user_id, ts, event_type FROM events")
def q_stream_dedup(spark, sf):
    """Input: the events, and every click a second time (same id, same time), twenty minutes
    later; rows land in the order they arrive, so copies come in a later micro-batch too."""
    ev = table(spark, sf, "events").withColumn("arrives", F.col("ts"))
    again = ev.where(F.col("event_type") == "click").withColumn("arrives", F.col("ts") + F.expr("INTERVAL 20 MINUTES"))
    slices = [x.drop("arrives") for x in S.time_slices(ev.unionByName(again), by=F.col("arrives"))]
    return S.replay(lambda stream: S.dedup(stream()), slices, "stream-dedup").out


@job("stream_static_join", sql="""
  SELECT event_id, user_id, ts, c_mktsegment, c_nationkey
  FROM events LEFT JOIN customer ON user_id = c_custkey
""")
def q_stream_static_join(spark, sf):
    j = S.static_join(_events(spark, sf), table(spark, sf, "customer"))
    return spark.read.parquet(S.run_to_parquet(j, "stream-static-join"))


@job("stream_stream_join", sql="""
  SELECT c.event_id AS click_id, p.event_id AS purchase_id, c.user_id AS user_id,
         c.ts AS click_ts, p.ts AS purchase_ts
  FROM events c JOIN events p ON c.user_id = p.user_id
   AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 30 MINUTE
  WHERE c.event_type = 'click' AND p.event_type = 'purchase'
""")
def q_stream_stream_join(spark, sf):
    def join(stream):
        return S.click_then_purchase(stream().where(F.col("event_type") == "click"), stream().where(F.col("event_type") == "purchase"))
    return _replayed(spark, sf, join, "stream-stream-join")


@job("stream_stateful", sql="""
  SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1
""")
def q_stream_stateful(spark, sf):
    """Totals per user, added up from its spans of activity: a user idle for an hour leaves
    the state, and its span goes out."""
    spans = _replayed(spark, sf, lambda stream: S.activity_totals(stream()), "stream-stateful", closing=True)
    return spans.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@job("stream_upsert", sql="""
  SELECT user_id, event_id, ts, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1
""")
def q_stream_upsert(spark, sf):
    out, ckpt = scratch_path(spark, "stream-upsert"), scratch_path(spark, "stream-upsert-ckpt")
    S.upsert_batches(_events(spark, sf), out, ckpt, S.latest_per_user)
    return S.compact_latest(spark, out)
