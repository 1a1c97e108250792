"""Projection, set operations, joins, aggregation and window jobs on the TPC-H-like
and events tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.operators import joins as J
from quarry.operators import relational as R
from quarry.operators import windows as W
from quarry.plans.registry import job
from quarry.session import materialize
from quarry.sources.tables import table

# ------------------------------------------------------------------ projection & sets


@job("project_filter", sql="""
  SELECT l_orderkey, l_linenumber, l_quantity,
         round(l_extendedprice * (1 - l_discount), 4) AS net,
         CAST(year(l_shipdate) AS INTEGER) AS ship_year
  FROM lineitem
  WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R')
    AND l_linestatus LIKE 'F%' AND l_shipdate IS NOT NULL AND l_discount > 0.05
""")
def q_project_filter(spark, sf):
    li = table(spark, sf, "lineitem")
    pred = (F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R")
            & F.col("l_linestatus").like("F%") & F.col("l_shipdate").isNotNull()
            & (F.col("l_discount") > 0.05))
    return R.project_filter(li, [
        "l_orderkey", "l_linenumber", "l_quantity",
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"),
        F.year("l_shipdate").alias("ship_year")], pred)


@job("distinct_rows", sql="SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def q_distinct_rows(spark, sf):
    return R.distinct_rows(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"])


@job("sort_limit_topk", sql="""
  SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def q_sort_limit_topk(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.top_k(o, 10, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def _nations(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return c, s


_NATIONS_SQL = ("(SELECT c_nationkey AS nationkey FROM customer)",
                "(SELECT s_nationkey AS nationkey FROM supplier)")


@job("union_all", sql=f"SELECT * FROM {_NATIONS_SQL[0]} UNION ALL SELECT * FROM {_NATIONS_SQL[1]}")
def q_union_all(spark, sf):
    return R.union_all(*_nations(spark, sf))


@job("union_distinct", sql=f"SELECT * FROM {_NATIONS_SQL[0]} UNION SELECT * FROM {_NATIONS_SQL[1]}")
def q_union_distinct(spark, sf):
    return R.union_distinct(*_nations(spark, sf))


# customers with orders in two statuses, with multiplicity (INTERSECT ALL / EXCEPT ALL)
_F = "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"
_O = "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"


def _status_keys(spark, sf, st):
    return table(spark, sf, "orders").where(F.col("o_orderstatus") == st).select("o_custkey")


@job("intersect_rows", sql=f"SELECT * FROM {_F} INTERSECT ALL SELECT * FROM {_O}")
def q_intersect_rows(spark, sf):
    return R.intersect_rows(_status_keys(spark, sf, "F"), _status_keys(spark, sf, "O"))


@job("intersect_distinct", sql=f"SELECT * FROM {_F} INTERSECT SELECT * FROM {_O}")
def q_intersect_distinct(spark, sf):
    return R.intersect_rows(_status_keys(spark, sf, "F"), _status_keys(spark, sf, "O"), False)


@job("except_rows", sql=f"SELECT * FROM {_F} EXCEPT ALL SELECT * FROM {_O}")
def q_except_rows(spark, sf):
    return R.except_rows(_status_keys(spark, sf, "F"), _status_keys(spark, sf, "O"))


@job("except_distinct", sql=f"SELECT * FROM {_F} EXCEPT SELECT * FROM {_O}")
def q_except_distinct(spark, sf):
    return R.except_rows(_status_keys(spark, sf, "F"), _status_keys(spark, sf, "O"), False)


# ------------------------------------------------------------------------------ joins


@job("join_inner", sql="""
  SELECT l_orderkey, l_linenumber, o_custkey, c_mktsegment, o_orderdate, l_extendedprice
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
""")
def q_join_inner(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    j = J.equi_join(li, o, li.l_orderkey == o.o_orderkey)
    j = J.equi_join(j, c, j.o_custkey == c.c_custkey)
    return j.select("l_orderkey", "l_linenumber", "o_custkey", "c_mktsegment", "o_orderdate",
                    "l_extendedprice")


@job("join_broadcast", sql="""
  SELECT r_name, n_name, count(*) AS n_lines,
         round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY 1, 2
""")
def q_join_broadcast(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice", "l_discount")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    geo = J.dimension_join(n, r, n.n_regionkey == r.r_regionkey)       # 25 rows
    sup = J.dimension_join(s, geo, s.s_nationkey == geo.n_nationkey)   # supplier-sized
    j = J.dimension_join(li, sup, li.l_suppkey == sup.s_suppkey)
    return (j.groupBy("r_name", "n_name")
             .agg(F.count(F.lit(1)).alias("n_lines"),
                  F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4)
                   .alias("revenue")))


# Outer-join outputs: integer columns that are null for unmatched rows are returned as
# DOUBLE in both the job and its SQL, so both engines hand over the same pandas dtype.
@job("join_left", sql="""
  SELECT c_custkey, c_name, CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey
""")
def q_join_left(spark, sf):
    """Every customer with its orders; customers without any once."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    j = J.equi_join(c, o, c.c_custkey == o.o_custkey, "left")
    return j.select("c_custkey", "c_name", F.col("o_orderkey").cast("double").alias("o_orderkey"), "o_totalprice")


@job("join_right", sql="""
  SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
         p_partkey, p_name
  FROM lineitem RIGHT JOIN part ON l_partkey = p_partkey
""")
def q_join_right(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    j = J.equi_join(li, p, li.l_partkey == p.p_partkey, "right")
    return j.select(F.col("l_orderkey").cast("double").alias("l_orderkey"),
                    F.col("l_linenumber").cast("double").alias("l_linenumber"), "p_partkey", "p_name")


@job("join_full", sql="""
  SELECT CAST(e.event_id AS DOUBLE) AS event_id, e.event_type, CAST(c.c_custkey AS DOUBLE) AS c_custkey, c.c_name
  FROM events e FULL JOIN customer c ON e.user_id = c.c_custkey
""")
def q_join_full(spark, sf):
    """Events and customers: users that are no customers, and customers without events."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    j = J.equi_join(e, c, e.user_id == c.c_custkey, "full")
    return j.select(F.col("event_id").cast("double").alias("event_id"), "event_type",
                    F.col("c_custkey").cast("double").alias("c_custkey"), "c_name")


@job("join_semi", sql="""
  SELECT c_custkey, c_name, c_mktsegment FROM customer
  WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""")
def q_join_semi(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    o = table(spark, sf, "orders").select("o_custkey")
    return J.equi_join(c, o, c.c_custkey == o.o_custkey, "left_semi")


@job("join_anti", sql="""
  SELECT c_custkey, c_name, c_mktsegment FROM customer
  WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""")
def q_join_anti(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    o = table(spark, sf, "orders").select("o_custkey")
    return J.equi_join(c, o, c.c_custkey == o.o_custkey, "left_anti")


# Overlapping price bands (name, low inclusive, high exclusive).
PRICE_BANDS = [("small", 0.0, 50000.0), ("medium", 25000.0, 150000.0),
               ("large", 100000.0, 300000.0), ("huge", 250000.0, 1.0e9)]


@job("join_theta", sql="""
  SELECT o_orderkey, band FROM orders JOIN (VALUES {bands}) AS b(band, lo, hi)
    ON o_totalprice >= lo AND o_totalprice < hi
""".replace("{bands}", ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in PRICE_BANDS)))
def q_join_theta(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    bands = spark.createDataFrame(PRICE_BANDS, "band string, lo double, hi double")
    return J.band_join(o, "o_totalprice", bands, "lo", "hi").select("o_orderkey", "band")


@job("join_theta_bands", sql="""
  SELECT o_orderkey, c_custkey FROM orders JOIN customer
    ON o_totalprice >= c_acctbal * 30 AND o_totalprice < c_acctbal * 30 + 5
""")
def q_join_theta_bands(spark, sf):
    """Orders against a price band of every customer."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * 30).alias("lo"), (F.col("c_acctbal") * 30 + 5).alias("hi"))
    return J.band_join(o, "o_totalprice", c, "lo", "hi").select("o_orderkey", "c_custkey")


@job("join_interval", sql="""
  SELECT a.event_id AS l_event_id, b.event_id AS r_event_id, a.user_id AS user_id,
         CAST(date_diff('second', a.ts, b.ts) AS BIGINT) AS gap_s
  FROM events a JOIN events b ON a.user_id = b.user_id
   AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE
""")
def q_join_interval(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    j = J.interval_join(e, e, "user_id", "ts", 600)
    # seconds boundaries crossed (whole seconds of each time, then the difference)
    gap = F.floor(W.micros(j, "r_ts") / 1_000_000) - F.floor(W.micros(j, "l_ts") / 1_000_000)
    return j.select("l_event_id", "r_event_id", F.col("l_user_id").alias("user_id"),
                    gap.cast("bigint").alias("gap_s"))


@job("join_asof", sql="""
  SELECT e.event_id, e.user_id, e.ts, CAST(p.event_id AS DOUBLE) AS r_event_id, p.ts AS r_ts,
         p.value AS r_value
  FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p
    ON e.user_id = p.user_id AND e.ts > p.ts
""")
def q_join_asof(spark, sf):
    e = table(spark, sf, "events")
    p = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    j = J.asof_join(e.select("event_id", "user_id", "ts"), p, "user_id", "ts",
                    ["event_id", "ts", "value"])
    return j.withColumn("r_event_id", F.col("r_event_id").cast("double"))


# ------------------------------------------------------------------------ aggregation


@job("agg_group", sql="""
  SELECT l_suppkey, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty,
         round(avg(l_quantity), 6) AS avg_qty, min(l_extendedprice) AS min_price,
         max(l_extendedprice) AS max_price, round(sum(l_extendedprice), 2) AS price
  FROM lineitem GROUP BY 1
""")
def q_agg_group(spark, sf):
    return A.group_agg(table(spark, sf, "lineitem"), ["l_suppkey"], [
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"),
        F.round(F.sum("l_extendedprice"), 2).alias("price")])


@job("agg_distinct", sql="""
  SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_cust,
         count(DISTINCT o_orderdate) AS n_dates, count(*) AS n
  FROM orders GROUP BY 1
""")
def q_agg_distinct(spark, sf):
    return A.group_agg(table(spark, sf, "orders"), ["o_orderpriority"], [
        F.countDistinct("o_custkey").alias("n_cust"), F.countDistinct("o_orderdate").alias("n_dates"),
        F.count(F.lit(1)).alias("n")])


@job("agg_approx_distinct", sql="""
  SELECT l_returnflag, count(*) AS n, CAST(round(log2(count(DISTINCT l_partkey))) AS BIGINT) AS parts_log2
  FROM lineitem GROUP BY 1
""")
def q_agg_approx_distinct(spark, sf):
    """Size of the set of parts per return flag, as a power of two, from stored sketches of
    each ship month merged on read."""
    li = table(spark, sf, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    stored = materialize(A.distinct_sketches(li, ["l_returnflag", "month"], "l_partkey"), "sketches")
    g = A.merged_distinct(stored, ["l_returnflag"])
    return g.select("l_returnflag", "n", F.round(F.log2("distinct")).cast("bigint").alias("parts_log2"))


@job("agg_percentile", sql="""
  SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS p25,
         quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75
  FROM lineitem GROUP BY 1
""")
def q_agg_percentile(spark, sf):
    return A.quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity",
                       [0.25, 0.5, 0.75])


@job("agg_stats", sql="""
  SELECT l_returnflag, l_linestatus, round(stddev_samp(l_quantity), 6) AS sd_qty,
         round(var_samp(l_quantity), 6) AS var_qty,
         round(corr(l_quantity, l_extendedprice), 6) AS corr_qty_price
  FROM lineitem GROUP BY 1, 2
""")
def q_agg_stats(spark, sf):
    return A.group_agg(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], [
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd_qty"),
        F.round(F.var_samp("l_quantity"), 6).alias("var_qty"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr_qty_price")])


@job("agg_collect", sql="""
  SELECT l_orderkey, chunk, array_to_string(list(l_partkey ORDER BY l_partkey), ',') AS items
  FROM (SELECT l_orderkey, l_partkey,
               (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1) // 1000 AS chunk
        FROM lineitem)
  GROUP BY 1, 2
""")
def q_agg_collect(spark, sf):
    return A.sorted_list(table(spark, sf, "lineitem"), ["l_orderkey"], "l_partkey")


_ML_AGGS_SQL = "count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty"


def _ml_aggs():
    return [F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")]


@job("agg_rollup", sql=f"""
  SELECT l_returnflag, l_linestatus, {_ML_AGGS_SQL},
         grouping_id(l_returnflag, l_linestatus) AS gid
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def q_agg_rollup(spark, sf):
    return A.multi_level(table(spark, sf, "lineitem"), "rollup",
                         ["l_returnflag", "l_linestatus"], _ml_aggs())


@job("agg_cube", sql=f"""
  SELECT l_returnflag, l_linestatus, {_ML_AGGS_SQL},
         grouping_id(l_returnflag, l_linestatus) AS gid
  FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
""")
def q_agg_cube(spark, sf):
    return A.multi_level(table(spark, sf, "lineitem"), "cube",
                         ["l_returnflag", "l_linestatus"], _ml_aggs())


_GSETS = """
  SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())
"""


@job("agg_grouping_sets", sql=_GSETS)
def q_agg_grouping_sets(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(_GSETS)


# The five event types of the events table.
EVENT_TYPES = ["signup", "purchase", "error", "view", "click"]


@job("agg_pivot", sql="SELECT user_id, " + ", ".join(
    f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES)
     + " FROM events GROUP BY 1")
def q_agg_pivot(spark, sf):
    return A.pivot_counts(table(spark, sf, "events"), "user_id", "event_type", EVENT_TYPES)


@job("agg_filter", sql="""
  SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done,
         round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS done_value,
         count(*) AS n
  FROM orders GROUP BY 1 HAVING count(*) > 12
""")
def q_agg_filter(spark, sf):
    done = F.col("o_orderstatus") == "F"
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.when(done, 1)).alias("n_done"),
        F.round(F.coalesce(F.sum(F.when(done, F.col("o_totalprice"))), F.lit(0.0)), 2)
         .alias("done_value"),
        F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") > 12)


# ---------------------------------------------------------------------------- windows


@job("win_rank", sql="""
  SELECT l_orderkey, l_linenumber, l_extendedprice,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn,
    rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS rnk,
    dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS drnk,
    ntile(3) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS tile
  FROM lineitem
""")
def q_win_rank(spark, sf):
    """Ranking lines within their order. Orders are small in TPC-H, but nothing here
    relies on it: the value-range split of ``rank_spread`` ranks a huge order in many
    tasks too."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return W.rank_spread(li, "l_orderkey", "l_extendedprice", "l_linenumber", tiles=3)


@job("win_rank_supplier", sql="""
  SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 16 + l_linenumber) AS rn,
    rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rnk,
    dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS drnk,
    ntile(4) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 16 + l_linenumber) AS tile
  FROM lineitem
""")
def q_win_rank_supplier(spark, sf):
    """Ranking inside groups with no size bound (a supplier's lines): value-range
    buckets spread a hot supplier over many tasks."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice",
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("line_id"))
    r = W.rank_spread(li, "l_suppkey", "l_extendedprice", "line_id", tiles=4)
    return r.drop("line_id")


@job("win_topn", sql="""
  SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (
    SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (
      PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
  WHERE rn <= 3
""")
def q_win_topn(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    t = W.top_n_per_group(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return t.withColumn("rn", F.col("rn").cast("bigint"))


@job("win_lag_lead", sql="""
  SELECT event_id, user_id, ts, event_type,
    lag(ts) OVER w AS prev_ts, lag(event_type) OVER w AS prev_event_type,
    lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_event_type
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def q_win_lag_lead(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return W.lag_lead(e, "user_id", "ts", "event_id", ["ts", "event_type"])


@job("win_running", sql="""
  SELECT event_id, user_id, ts, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running
  FROM events
""")
def q_win_running(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    r = W.running_total(e, "user_id", "ts", "event_id", "value")
    return r.select("event_id", "user_id", "ts", F.round("running", 2).alias("running"))


@job("win_range", sql="""
  SELECT event_id, user_id, ts,
    count(*) OVER w AS n_trailing, round(sum(value) OVER w, 2) AS sum_trailing
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts
    RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)
""")
def q_win_range(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    r = W.trailing_range(e, "user_id", "ts", "value", 3600)
    return r.select("event_id", "user_id", "ts", "n_trailing",
                    F.round("sum_trailing", 2).alias("sum_trailing"))


@job("win_first_last", sql="""
  SELECT event_id, user_id, day, event_type, first_value(event_type) OVER w AS first_event_type,
    last_value(event_type) OVER w AS last_event_type, nth_value(event_type, 2) OVER w AS nth2_event_type
  FROM (SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events)
  WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def q_win_first_last(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type") \
        .withColumn("day", F.to_date("ts").cast("timestamp_ntz"))
    r = W.first_last(e, ["user_id", "day"], [F.col("ts"), F.col("event_id")], "event_type")
    return r.drop("ts")
