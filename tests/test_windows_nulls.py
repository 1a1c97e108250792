"""Split (many-range) and fixed-bucket window operators keep every row when keys,
times or values are null, and order nulls as Spark does (first ascending, last
descending). Compared with DuckDB told to order nulls the same way."""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import rows
from conftest import SF_SMALL
from quarry.operators import joins as J
from quarry.operators import windows as W
from quarry.sources.tables import table

SPLITS = [dict(target_rows=37), dict(bucket_seconds=3600), dict()]


@pytest.fixture(scope="module")
def nulls(spark):
    e = table(spark, SF_SMALL, "events").select("event_id", "user_id", "ts", "event_type", "value")
    no_user = (e.where(F.col("event_type") == "view")
                .withColumn("user_id", F.lit(None).cast("bigint"))
                .withColumn("event_id", F.col("event_id") + 1_000_000))
    no_ts = (e.where(F.col("event_type") == "error")
              .withColumn("ts", F.lit(None).cast("timestamp_ntz"))
              .withColumn("event_id", F.col("event_id") + 2_000_000))
    no_value = (e.where(F.col("event_type") == "signup")
                 .withColumn("value", F.lit(None).cast("double"))
                 .withColumn("event_id", F.col("event_id") + 3_000_000))
    df = e.unionByName(no_user).unionByName(no_ts).unionByName(no_value)
    con = duckdb.connect()
    con.execute("SET default_null_order = 'nulls_first_on_asc_last_on_desc'")
    con.register("ev", df.toPandas())
    return df, con


def check(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(rel.columns, rel.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("split", SPLITS)
def test_lag_lead(nulls, split):
    df, con = nulls
    out = W.lag_lead(df.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id",
                     ["event_id"], **split)
    check(out, con, """SELECT event_id, user_id, ts, lag(event_id) OVER w AS prev_event_id,
        lead(event_id) OVER w AS next_event_id FROM ev
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")


@pytest.mark.parametrize("split", SPLITS)
def test_running_total(nulls, split):
    df, con = nulls
    out = W.running_total(df.select("event_id", "user_id", "ts", "value"), "user_id", "ts",
                          "event_id", "value", **split).withColumn("running", F.round("running", 2))
    check(out, con, """SELECT event_id, user_id, ts, value, round(sum(value) OVER (
        PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM ev""")


@pytest.mark.parametrize("split", SPLITS)
def test_trailing_range(nulls, split):
    df, con = nulls
    out = W.trailing_range(df.select("event_id", "user_id", "ts", "value"), "user_id", "ts",
                           "value", 1800, **split).withColumn("sum_trailing", F.round("sum_trailing", 2))
    check(out, con, """SELECT event_id, user_id, ts, value, count(*) OVER w AS n_trailing,
        round(sum(value) OVER w, 2) AS sum_trailing FROM ev WINDOW w AS (PARTITION BY user_id
        ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW)""")


@pytest.mark.parametrize("split", SPLITS)
def test_asof(nulls, split):
    df, con = nulls
    left = df.select("event_id", "user_id", "ts")
    right = df.where(F.col("event_type").isin("view", "error")).select("event_id", "user_id", "ts")
    out = J.asof_join(left, right, "user_id", "ts", ["event_id"], **split)
    check(out, con, """SELECT e.event_id, e.user_id, e.ts, p.event_id AS r_event_id
        FROM ev e ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type IN ('view', 'error')) p
        ON e.user_id = p.user_id AND e.ts > p.ts""")


@pytest.mark.parametrize("buckets", [None, 8])
def test_rank_spread(nulls, buckets):
    df, con = nulls
    out = W.rank_spread(df.select("user_id", "event_id", "value"), "user_id", "value", "event_id",
                        tiles=3, buckets=buckets)
    check(out, con, """SELECT user_id, event_id, value,
        row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn,
        rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS rnk,
        dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS drnk,
        ntile(3) OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS tile FROM ev""")


def test_first_last(nulls):
    df, con = nulls
    e = df.where(F.col("ts").isNotNull()).select("event_id", "user_id", "ts", "event_type")
    out = W.first_last(e, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type")
    check(out, con, """SELECT event_id, user_id, ts, event_type,
        first_value(event_type) OVER w AS first_event_type,
        last_value(event_type) OVER w AS last_event_type,
        nth_value(event_type, 2) OVER w AS nth2_event_type
        FROM ev WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")


def test_pandas_groups_keep_null_keys(spark):
    """Grouped pandas code treats a null key as one group, like Spark's groupBy."""
    from quarry.functions import udfs as U
    li = table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_linenumber",
                                                   "l_extendedprice", "l_quantity")
    li = li.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 5 == 0, F.lit(None))
                                      .otherwise(F.col("l_orderkey")).cast("bigint"))
    con = duckdb.connect()
    con.register("li", li.toPandas())
    check(U.quantity_spread(li), con,
          "SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS qty_spread FROM li GROUP BY 1")
    check(U.line_shares(li), con, """SELECT l_orderkey, l_linenumber, round(l_extendedprice /
        sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM li""")


@pytest.mark.parametrize("split", SPLITS)
def test_naive_times_ignore_the_session_zone(spark, split):
    """timestamp_ntz values are naive wall-clock times: in a session zone with
    daylight saving, 01:30 -> 03:10 on the spring-forward day is still 100 minutes
    (as in SQL), and the repeated autumn hour is not folded."""
    from datetime import datetime, timedelta
    base = [datetime(2024, 3, 10, 0, 0), datetime(2024, 11, 3, 0, 0)]
    rows_ = [(i, i % 2, b + timedelta(minutes=17 * j), float(j))
             for i, (b, j) in enumerate((b, j) for b in base for j in range(16))]
    df = spark.createDataFrame(rows_, "event_id long, user_id long, ts timestamp_ntz, value double")
    con = duckdb.connect()
    con.register("ev", df.toPandas())
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    spark.conf.set(key, "America/New_York")
    try:
        tr = W.trailing_range(df, "user_id", "ts", "value", 3600, **split)
        check(tr, con, """SELECT event_id, user_id, ts, value, count(*) OVER w AS n_trailing,
            sum(value) OVER w AS sum_trailing FROM ev WINDOW w AS (PARTITION BY user_id
            ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
        ij = J.interval_join(df.select("event_id", "user_id", "ts"),
                             df.select("event_id", "user_id", "ts"), "user_id", "ts", 3600)
        check(ij.select("l_event_id", "r_event_id"), con, """SELECT a.event_id AS l_event_id,
            b.event_id AS r_event_id FROM ev a JOIN ev b ON a.user_id = b.user_id
            AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
    finally:
        spark.conf.set(key, old)
