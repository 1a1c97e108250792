"""Configured and named sources/sinks: Parquet, JSON, catalog tables, Arrow, SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from quarry.plans import sql as sqlq
from quarry.plans.registry import job
from quarry.session import materialize, scratch_path
from quarry.sources import formats
from quarry.sources.tables import table


@job("src_parquet", sql="""
  SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty,
         round(sum(l_extendedprice), 2) AS price
  FROM lineitem WHERE l_returnflag IN ('A', 'R')
  GROUP BY 1, 2
""")
def q_src_parquet(spark, sf):
    """Partitioned write, then a read whose filter on the partition column prunes
    folders (PartitionFilters in the scan) and whose projection prunes columns."""
    path = scratch_path(spark, "lineitem-by-flag")
    li = table(spark, sf, "lineitem")
    formats.write_parquet(li, path, ["l_returnflag", "l_linestatus"])
    back = formats.read_parquet(spark, path).where(F.col("l_returnflag").isin("A", "R"))
    return (back.groupBy("l_returnflag", "l_linestatus")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"),
                     F.round(F.sum("l_extendedprice"), 2).alias("price")))


ORDERS_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
                 "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")


@job("src_json", sql="""
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders
""")
def q_src_json(spark, sf):
    """JSON-lines round trip of the whole orders table with an explicit schema."""
    path = scratch_path(spark, "orders-json")
    formats.write_json(table(spark, sf, "orders"), path)
    return formats.read_json(spark, path, ORDERS_SCHEMA)


@job("src_json_inferred", sql="""
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
""")
def q_src_json_inferred(spark, sf):
    """JSON-lines round trip of the whole orders table with the schema, times included,
    inferred from the data."""
    path = scratch_path(spark, "orders-json-inferred")
    o = table(spark, sf, "orders")
    formats.write_json(o, path)
    return formats.read_json(spark, path).select(*o.columns)


@job("managed_table", sql="""
  SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY 1
""")
def q_managed_table(spark, sf):
    """Create a managed table from the 'F' orders, append the rest, read it back, drop it."""
    name = "orders_" + scratch_path(spark, "t").rsplit("-", 1)[-1]
    o = table(spark, sf, "orders")
    formats.create_table(o.where(F.col("o_orderstatus") == "F"), name)
    try:
        formats.append_table(o.where(F.col("o_orderstatus") != "F"), name)
        return materialize(spark.table(name).groupBy("o_orderstatus")
                                .agg(F.count(F.lit(1)).alias("n"),
                                     F.round(F.sum("o_totalprice"), 2).alias("total")), "managed-result")
    finally:
        spark.sql(f"DROP TABLE {name}")


@job("src_hive_table", sql="""
  SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
  GROUP BY 1
""")
def q_src_hive_table(spark, sf):
    """Catalog table through SQL DDL/DML: a table partitioned by market segment,
    filled with INSERT ... SELECT, queried with a partition filter. It is a Hive
    metastore table when the session has Hive support, else a session-catalog table."""
    suffix = scratch_path(spark, "t").rsplit("-", 1)[-1]
    name, src, nation = f"customer_{suffix}", f"customer_src_{suffix}", f"nation_{suffix}"
    table(spark, sf, "customer").createOrReplaceTempView(src)
    table(spark, sf, "nation").createOrReplaceTempView(nation)
    loc = scratch_path(spark, "warehouse-" + name)
    spark.sql(f"""CREATE TABLE {name} (c_custkey BIGINT, c_name STRING, c_nationkey INT,
                  c_acctbal DOUBLE, c_mktsegment STRING)
                  USING parquet PARTITIONED BY (c_mktsegment) LOCATION '{loc}'""")
    spark.sql(f"INSERT INTO {name} SELECT c_custkey, c_name, c_nationkey, c_acctbal, "
              f"c_mktsegment FROM {src}")
    try:
        return materialize(spark.sql(f"""
            SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS acctbal
            FROM {name} JOIN {nation} ON c_nationkey = n_nationkey
            WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY n_name"""), "hive-result")
    finally:
        spark.sql(f"DROP TABLE {name}")
        spark.catalog.dropTempView(src)
        spark.catalog.dropTempView(nation)


def _net_price(b: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({
        "l_orderkey": b["l_orderkey"], "l_linenumber": b["l_linenumber"],
        "net": (b["l_extendedprice"] * (1 - b["l_discount"])).round(4),
    })


@job("arrow_pandas_batch", sql="""
  SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net
  FROM lineitem
""")
def q_arrow_pandas_batch(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber",
                                             "l_extendedprice", "l_discount")
    return formats.arrow_map(li, _net_price, "l_orderkey long, l_linenumber int, net double")


@job("arrow_small_result", sql="""
  SELECT n_regionkey AS regionkey, sum(customers) AS customers, count(*) AS nations, min(n_name) AS first
  FROM (SELECT n_regionkey, n_name, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
        GROUP BY 1, 2) GROUP BY 1
""")
def q_arrow_small_result(spark, sf):
    """A small result as one pandas frame and back: customers per nation (a Spark
    aggregate, one row per nation), summed up per region in pandas."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    per = (n.join(c, n.n_nationkey == c.c_nationkey, "left").groupBy("n_regionkey", "n_name")
            .agg(F.count("c_custkey").alias("customers")))

    def regions(b: pd.DataFrame) -> pd.DataFrame:
        g = b.groupby("n_regionkey", as_index=False).agg(customers=("customers", "sum"), nations=("n_name", "size"),
                                                         first=("n_name", "min"))
        return g.rename(columns={"n_regionkey": "regionkey"})
    return formats.small_pandas(per, regions, "regionkey int, customers long, nations long, first string")


@job("sql_on_dataframe", sql=sqlq.duck(sqlq.Q1))
def q_sql_q1(spark, sf):
    return sqlq.run_sql(spark, sf, sqlq.Q1, ["lineitem"])


@job("sql_tpch_q3", sql=sqlq.duck(sqlq.Q3))
def q_sql_q3(spark, sf):
    return sqlq.run_sql(spark, sf, sqlq.Q3, ["customer", "orders", "lineitem"])


@job("sql_tpch_q5", sql=sqlq.duck(sqlq.Q5))
def q_sql_q5(spark, sf):
    return sqlq.run_sql(spark, sf, sqlq.Q5, ["customer", "orders", "lineitem", "supplier",
                                             "nation", "region"])
