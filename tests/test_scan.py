"""Prefix scan of hot keys: same rows as plain windows, and what its plan moves."""

import random

import duckdb
import pytest
from compare import rows
from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.operators import scan
from quarry.operators import windows as W


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows: key 0 holds two thirds, with one value in half of its rows; null keys and
    values; ids are unique."""
    r = random.Random(6)
    data = [(0 if i % 3 else r.choice([1, 2, 3, None]), 5.0 if i % 2 else r.choice([None, float("nan"), -1.0, 0.0, 2.5, 7.25, float(r.randrange(40))]), i)
            for i in range(900)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "k int, v double, id int")
    con = duckdb.connect()
    con.execute("SET default_null_order = 'nulls_first_on_asc_last_on_desc'")
    con.execute("CREATE TABLE t (k INTEGER, v DOUBLE, id INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", data)
    return df, con


def check(df, con, sql):
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


TARGETS = [7, 60, 100, 10_000]


@pytest.mark.parametrize("target", TARGETS)
def test_ranks(skewed, target):
    """At 7 rows a piece the value 5.0 of key 0 (some 300 rows) runs over dozens of pieces."""
    df, con = skewed
    check(W.rank_spread(df, "k", "v", "id", tiles=7, target_rows=target), con, """
        SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, id) AS rn, rank() OVER (PARTITION BY k ORDER BY v DESC) AS rnk,
          dense_rank() OVER (PARTITION BY k ORDER BY v DESC) AS drnk, ntile(7) OVER (PARTITION BY k ORDER BY v DESC, id) AS tile FROM t""")


@pytest.mark.parametrize("target", TARGETS)
def test_running_and_neighbours(skewed, target):
    df, con = skewed
    d = df.withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
    ts = d.withColumn("ts", F.timestamp_seconds(F.col("id") % 50))
    got = W.running_total(ts, "k", "ts", "id", "v", target_rows=target).drop("ts")
    check(got, con, """SELECT k, CASE WHEN isnan(v) THEN NULL ELSE v END AS v, id,
        sum(CASE WHEN isnan(v) THEN NULL ELSE v END) OVER (PARTITION BY k ORDER BY id % 50, id ROWS UNBOUNDED PRECEDING) AS running FROM t""")
    got = W.lag_lead(ts, "k", "ts", "id", ["id", "v"], target_rows=target).drop("ts", "v")
    check(got, con, """SELECT k, id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id, lag(x) OVER w AS prev_v, lead(x) OVER w AS next_v
        FROM (SELECT *, CASE WHEN isnan(v) THEN NULL ELSE v END AS x FROM t) WINDOW w AS (PARTITION BY k ORDER BY id % 50, id)""")


@pytest.mark.parametrize("target", [3, 10_000])
def test_quantiles_and_lists(skewed, target):
    df, con = skewed
    d = df.withColumn("v", (F.col("id") * 37 % 211).cast("double"))
    got = A.quantiles(d, ["k"], "v", [0.1, 0.5, 0.9], target_rows=target)
    check(got, con, """SELECT k, quantile_cont((id * 37 % 211)::DOUBLE, 0.1) AS p10, quantile_cont((id * 37 % 211)::DOUBLE, 0.5) AS p50,
        quantile_cont((id * 37 % 211)::DOUBLE, 0.9) AS p90 FROM t GROUP BY k""")
    whole = A.quantiles(d, [], "v", [0.5], target_rows=target)
    check(whole, con, "SELECT quantile_cont((id * 37 % 211)::DOUBLE, 0.5) AS p50 FROM t")
    got = A.sorted_list(df, ["k"], "id", size=11, target_rows=target)
    check(got, con, """SELECT k, n // 11 AS chunk, string_agg(id::VARCHAR, ',' ORDER BY id) AS items
        FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) - 1 AS n FROM t) GROUP BY ALL""")


def test_pieces_split_the_hot_key_and_its_ties(skewed):
    df, _ = skewed
    light, hot = scan.split_hot(df, ["k"], 100)
    assert {r.k for r in hot.select("k").distinct().collect()} == {0} and light.count() + hot.count() == 900
    t = scan.ranged(hot, [F.col("k"), F.col("v").desc(), F.col("id")], 50)
    sizes = [r.n for r in t.groupBy("k", "_b").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 110 and len(sizes) >= 8   # the sampled borders are approximate
    ends = t.groupBy("_b").agg(F.min("id").alias("a")).count()
    assert ends == len(sizes)
    assert scan.split_hot(df, ["k"], 900)[1] is None and scan.split_hot(df.limit(0), ["k"], 1)[1] is None


def test_rows_are_shuffled_once(skewed):
    """After the one exchange of ``ranged`` nothing moves the rows: in the plan of the result only
    broadcasts, exchanges of ``runs`` (one row per key and piece), and those of the other keys."""
    df, _ = skewed
    only_hot = df.where("k = 0")
    plan = W.rank_spread(only_hot, "k", "v", "id", target_rows=60, buckets=9)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert "Bucketed: true" in plan and "SelectedBucketsCount: 9 out of 9" in plan
    depth = [len(ln) - len(ln.lstrip(" :+-")) for ln in lines]
    scans = [i for i, ln in enumerate(lines) if "Bucketed: true" in ln]
    top = scans[0]   # the rows' own branch: the streamed side of the broadcast join
    path, d = [], depth[top]
    for i in range(top - 1, -1, -1):
        if depth[i] < d:
            path.append(lines[i].strip(" :+-"))
            d = depth[i]
    assert any("BroadcastHashJoin" in x for x in path) and any("Window" in x for x in path)
    assert not any(x.startswith(("Exchange", "BroadcastExchange")) for x in path), path
