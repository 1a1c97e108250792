"""Bucketed window and as-of operators against plain single-partition SQL (DuckDB),
on events where one user holds a third of all rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import rows
from conftest import SF_SMALL
from quarry.operators import joins as J
from quarry.operators import windows as W
from quarry.sources.tables import table


@pytest.fixture(scope="module")
def hot(spark):
    """events plus a copy of half of them re-assigned to user 999 (distinct ids),
    so user 999 holds a third of the rows."""
    e = table(spark, SF_SMALL, "events").select("event_id", "user_id", "ts", "event_type", "value")
    copy = (e.where(F.col("event_type").isin("view", "click", "error"))
             .withColumn("user_id", F.lit(999).cast("bigint"))
             .withColumn("event_id", F.col("event_id") + 1_000_000))
    df = e.unionByName(copy)
    pdf = df.toPandas()
    n_hot = int((pdf.user_id == 999).sum())
    assert n_hot * 4 > len(pdf)   # roughly a third or more
    con = duckdb.connect()
    con.register("ev", pdf)
    return df, con


def check(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


# How rows are cut: fixed-width buckets, or global quantile ranges (a tiny row target
# forces many ranges on the small fixture; the default gives a single range).
SPLITS = [dict(bucket_seconds=600), dict(bucket_seconds=86_400), dict(target_rows=37),
          dict(target_rows=500), dict()]


@pytest.mark.parametrize("split", SPLITS)
def test_lag_lead(hot, split):
    df, con = hot
    out = W.lag_lead(df.select("event_id", "user_id", "ts", "event_type"), "user_id", "ts",
                     "event_id", ["ts", "event_type"], **split)
    check(out, con, """SELECT event_id, user_id, ts, event_type,
        lag(ts) OVER w AS prev_ts, lag(event_type) OVER w AS prev_event_type,
        lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_event_type
        FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")


@pytest.mark.parametrize("split", SPLITS)
def test_running_total(hot, split):
    df, con = hot
    out = W.running_total(df.select("event_id", "user_id", "ts", "value"), "user_id", "ts",
                          "event_id", "value", **split)
    out = out.withColumn("running", F.round("running", 2))
    check(out, con, """SELECT event_id, user_id, ts, value, round(sum(value) OVER (
        PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM ev""")


@pytest.mark.parametrize("split", SPLITS)
def test_trailing_range(hot, split):
    df, con = hot
    out = W.trailing_range(df.select("event_id", "user_id", "ts", "value"), "user_id", "ts",
                           "value", 1800, **split).withColumn("sum_trailing", F.round("sum_trailing", 2))
    check(out, con, """SELECT event_id, user_id, ts, value, count(*) OVER w AS n_trailing,
        round(sum(value) OVER w, 2) AS sum_trailing FROM ev WINDOW w AS (PARTITION BY user_id
        ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW)""")


@pytest.mark.parametrize("split", [dict(bucket_seconds=3600), dict(target_rows=37), dict()])
@pytest.mark.parametrize("strict", [True, False])
def test_asof(hot, strict, split):
    df, con = hot
    left = df.select("event_id", "user_id", "ts")
    right = df.where(F.col("event_type") == "view").select("event_id", "user_id", "ts", "value")
    out = J.asof_join(left, right, "user_id", "ts", ["event_id", "value"],
                      strict=strict, **split)
    op = ">" if strict else ">="
    check(out, con, f"""SELECT e.event_id, e.user_id, e.ts, p.event_id AS r_event_id,
        p.value AS r_value FROM ev e ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') p
        ON e.user_id = p.user_id AND e.ts {op} p.ts""")


def test_interval_join(hot):
    df, con = hot
    e = df.select("event_id", "user_id", "ts")
    out = J.interval_join(e, e, "user_id", "ts", 300).select("l_event_id", "r_event_id")
    check(out, con, """SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM ev a
        JOIN ev b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 5 MINUTE""")


@pytest.fixture(scope="module")
def hot_lines(spark):
    """lineitem plus a copy of every line moved to supplier 999 (half of all rows), and
    a small supplier 998 whose lines all share one price (all ties)."""
    li = table(spark, SF_SMALL, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("line_id"),
        "l_extendedprice")
    copy = (li.withColumn("l_suppkey", F.lit(999).cast("bigint"))
              .withColumn("line_id", F.col("line_id") + 10 ** 9))
    ties = (li.orderBy("line_id").limit(50).withColumn("l_suppkey", F.lit(998).cast("bigint"))
              .withColumn("line_id", F.col("line_id") + 2 * 10 ** 9)
              .withColumn("l_extendedprice", F.lit(100.0)))
    df = li.unionByName(copy).unionByName(ties)
    con = duckdb.connect()
    con.register("li", df.toPandas())
    return df, con


@pytest.mark.parametrize("split", [dict(buckets=2), dict(buckets=16), dict(buckets=64),
                                   dict(target_rows=20)])
def test_rank_spread(hot_lines, split):
    """Includes supplier 998, a tie group of 50 rows that the tie ranges split."""
    df, con = hot_lines
    out = W.rank_spread(df, "l_suppkey", "l_extendedprice", "line_id", tiles=3, **split)
    check(out, con, """SELECT l_suppkey, line_id, l_extendedprice,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, line_id) AS rn,
        rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rnk,
        dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS drnk,
        ntile(3) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, line_id) AS tile
        FROM li""")


def test_ranges_bound_the_hot_key(hot):
    """Quantile ranges cut the hot user's sequence into groups of about the row target
    (the sketch's rank error allows up to twice that); plain per-user groups do not."""
    df, _ = hot
    d = W.with_bucket(df, "ts", target_rows=100)
    per_user = df.groupBy("user_id").count().agg(F.max("count")).first()[0]
    per_range = d.groupBy("user_id", "_b").count().agg(F.max("count")).first()[0]
    assert per_user > 400
    assert per_range <= 200


@pytest.fixture(scope="module")
def burst(spark):
    """events plus user 999 with 400 rows at one instant and 200 rows without a time:
    neither group can be separated by cuts of the time axis alone."""
    e = table(spark, SF_SMALL, "events").select("event_id", "user_id", "ts", "value")
    same = (e.limit(400).withColumn("user_id", F.lit(999).cast("bigint"))
             .withColumn("event_id", F.col("event_id") + 1_000_000)
             .withColumn("ts", F.lit("2024-01-05 12:00:00").cast("timestamp_ntz")))
    no_ts = (e.limit(200).withColumn("user_id", F.lit(999).cast("bigint"))
              .withColumn("event_id", F.col("event_id") + 2_000_000)
              .withColumn("ts", F.lit(None).cast("timestamp_ntz")))
    df = e.unionByName(same).unionByName(no_ts)
    con = duckdb.connect()
    con.execute("SET default_null_order = 'nulls_first_on_asc_last_on_desc'")
    con.register("ev", df.toPandas())
    return df, con


def test_burst_is_split_by_the_tie_breaker(burst):
    df, con = burst
    d = W.with_bucket(df, "ts", target_rows=50, tie="event_id")
    biggest = d.groupBy("user_id", "_b").count().agg(F.max("count")).first()[0]
    assert biggest <= 120
    out = W.lag_lead(df, "user_id", "ts", "event_id", ["event_id"], target_rows=50)
    check(out.select("event_id", "user_id", "ts", "value", "prev_event_id", "next_event_id"), con,
          """SELECT event_id, user_id, ts, value, lag(event_id) OVER w AS prev_event_id,
          lead(event_id) OVER w AS next_event_id FROM ev
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
    run = W.running_total(df, "user_id", "ts", "event_id", "value", target_rows=50)
    check(run.withColumn("running", F.round("running", 2)), con, """SELECT event_id, user_id,
        ts, value, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING), 2) AS running FROM ev""")


def test_burst_asof(burst):
    """Left and right rows at one instant fold to one lookup per (user, time); the
    matched time is compared (several right rows share it)."""
    df, con = burst
    right = df.where(F.col("value") > 100).select("event_id", "user_id", "ts")
    out = J.asof_join(df.select("event_id", "user_id", "ts"), right, "user_id", "ts", ["ts"],
                      target_rows=50)
    check(out, con, """SELECT e.event_id, e.user_id, e.ts, p.ts AS r_ts
        FROM ev e ASOF LEFT JOIN (SELECT * FROM ev WHERE value > 100) p
        ON e.user_id = p.user_id AND e.ts > p.ts""")


def test_burst_interval_join(burst):
    """400 rows at one instant never pair with each other (strict lower bound) and
    are matched as one instant."""
    df, con = burst
    e = df.select("event_id", "user_id", "ts")
    out = J.interval_join(e, e, "user_id", "ts", 3600).select("l_event_id", "r_event_id")
    check(out, con, """SELECT a.event_id AS l_event_id, b.event_id AS r_event_id FROM ev a
        JOIN ev b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
