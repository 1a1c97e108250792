"""SQL text over DataFrames: register views, let Catalyst plan the statement.

The statements are TPC-H Q1-, Q3- and Q5-shaped, adapted to the test tables' columns
and date range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import table

Q1 = """
SELECT l_returnflag, l_linestatus,
       sum(l_quantity) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty,
       round(avg(l_extendedprice), 2) AS avg_price,
       round(avg(l_discount), 6) AS avg_disc,
       count(*) AS count_order
FROM lineitem
WHERE l_shipdate <= TIMESTAMP_NTZ '2001-09-01 00:00:00'
GROUP BY l_returnflag, l_linestatus
"""

Q3 = """
SELECT l_orderkey,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue,
       o_orderdate, o_orderpriority
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING'
  AND c_custkey = o_custkey
  AND l_orderkey = o_orderkey
  AND o_orderdate < TIMESTAMP_NTZ '1998-03-15 00:00:00'
  AND l_shipdate > TIMESTAMP_NTZ '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate, o_orderpriority
"""

Q5 = """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey
  AND l_orderkey = o_orderkey
  AND l_suppkey = s_suppkey
  AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey
  AND r_name = 'ASIA'
  AND o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'
  AND o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'
GROUP BY n_name
"""


def register_views(spark: SparkSession, sf_dir: str, names) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def run_sql(spark: SparkSession, sf_dir: str, statement: str, names) -> DataFrame:
    register_views(spark, sf_dir, names)
    return spark.sql(statement)


def duck(statement: str) -> str:
    """The same statement for DuckDB (its timestamp literal has no _NTZ suffix)."""
    return statement.replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
