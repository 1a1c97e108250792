"""Built-in scalar function families (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def string_funcs(customer: DataFrame) -> DataFrame:
    return customer.select(
        "c_custkey",
        F.upper("c_name").alias("up"),
        F.substring("c_name", 1, 8).alias("head"),
        F.trim(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("  "))).alias("trimmed"),
        F.concat_ws("-", "c_name", "c_mktsegment").alias("joined"),
        F.replace(F.col("c_name"), F.lit("Customer#"), F.lit("C")).alias("short"),
        F.length("c_mktsegment").alias("seg_len"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.rpad("c_mktsegment", 12, ".").alias("rpadded"),
        F.lower(F.reverse("c_mktsegment")).alias("rev"))


def regex_funcs(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.select(
        "page_id",
        F.regexp_extract(url, r"^(https?)://", 1).alias("scheme"),
        F.regexp_extract(url, r"^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_extract(url, r"/([a-z]{2})/", 1).alias("lang"),
        F.regexp_replace(url, r"[?#].*$", "").alias("bare"),
        url.rlike(r"[?&]page=[0-9]+").alias("paged"))


def date_funcs(orders: DataFrame) -> DataFrame:
    d = F.to_date("o_orderdate")
    return orders.select(
        "o_orderkey",
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"),
        F.quarter("o_orderdate").alias("q"), F.dayofmonth("o_orderdate").alias("dom"),
        F.trunc(d, "month").cast("timestamp_ntz").alias("month_start"),
        F.datediff(F.lit("2002-01-01").cast("date"), d).alias("days_left"),
        F.date_add(d, 30).cast("timestamp_ntz").alias("due"),
        F.last_day(d).cast("timestamp_ntz").alias("month_end"))


def math_funcs(lineitem: DataFrame) -> DataFrame:
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return lineitem.select(
        "l_orderkey", "l_linenumber",
        F.round(p / 7, 3).alias("r3"),
        F.floor(p / 100).alias("fl"), F.ceil(p / 100).alias("ce"),
        F.round(F.log(p), 6).alias("ln_price"),
        F.pow(q, 2).alias("q2"), F.round(F.sqrt(q), 6).alias("sq"),
        (F.col("l_orderkey") % 7).alias("m7"),
        F.try_divide(p, q - q).alias("safe_div"),
        F.abs(F.col("l_discount") - 0.05).alias("dev"), F.signum(F.col("l_tax") - 0.04).alias("sg"))


def conditional_funcs(customer: DataFrame) -> DataFrame:
    b = F.col("c_acctbal")
    return customer.select(
        "c_custkey",
        F.when(b < 0, "neg").when(b < 5000, "mid").otherwise("high").alias("tier"),
        F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("B")).alias("seg"),
        F.greatest(b, F.lit(0.0)).alias("floor0"), F.least(b, F.lit(1000.0)).alias("cap1000"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("c_name")).alias("odd_name"))


def array_funcs(pages: DataFrame) -> DataFrame:
    """One row per url segment (posexplode) with whole-array facts alongside."""
    parts = F.split(F.col("url"), "/")
    base = pages.select("page_id", parts.alias("parts"))
    return base.select(
        "page_id",
        F.size("parts").alias("n_parts"),
        F.element_at("parts", 3).alias("host"),
        F.array_join(F.slice("parts", 2, 3), "|").alias("mid"),
        F.array_contains("parts", "en").alias("has_en"),
        F.posexplode("parts").alias("pos", "part"))


def higher_order_funcs(embeddings: DataFrame) -> DataFrame:
    """Vector norm, positive mass and a dot product with the reversed vector, computed
    in double with left-to-right folds."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    add = lambda acc, x: acc + x
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), add))
    pos = F.aggregate(F.filter(v, lambda x: x > 0), F.lit(0.0), add)
    dot = F.aggregate(F.zip_with(v, F.reverse(v), lambda a, b: a * b), F.lit(0.0), add)
    return embeddings.select("vec_id", F.round(norm, 6).alias("norm"),
                             F.round(pos, 6).alias("pos_mass"), F.round(dot, 6).alias("dot_rev"),
                             F.size(F.filter(v, lambda x: x > 0)).alias("n_pos"))


def map_struct_funcs(lineitem: DataFrame) -> DataFrame:
    m = F.map_from_entries(F.array(
        F.struct(F.lit("q").alias("k"), F.col("l_quantity").alias("v")),
        F.struct(F.lit("d").alias("k"), F.col("l_discount").alias("v"))))
    s = F.struct(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"))
    d = lineitem.select(m.alias("m"), s.alias("s"))
    return d.select(F.col("s.ok").alias("l_orderkey"), F.col("s.ln").alias("l_linenumber"),
                    F.col("m")["q"].alias("q"), F.element_at("m", F.lit("d")).alias("d"),
                    F.size(F.map_keys("m")).alias("n_keys"))


def json_funcs(events: DataFrame) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return events.select("event_id", F.get_json_object("props", "$.k").alias("k_text"),
                         parsed["k"].alias("k"))


def cast_funcs(orders: DataFrame) -> DataFrame:
    return orders.select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("prio"),
        F.col("o_orderpriority").try_cast("int").cast("double").alias("bad"),
        F.floor("o_totalprice").cast("bigint").alias("whole"),
        F.col("o_orderdate").cast("date").cast("timestamp_ntz").alias("d"),
        F.col("o_custkey").cast("string").alias("cust_text"),
        F.col("o_totalprice").cast("string").try_cast("double").alias("round_trip"))
