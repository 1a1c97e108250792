"""Scalar function families and Python UDF jobs."""

from __future__ import annotations

from quarry.functions import scalar as S
from quarry.functions import udfs as U
from quarry.plans.registry import job
from quarry.sources.tables import table


@job("S1_string", sql="""
  SELECT c_custkey, upper(c_name) AS up, substr(c_name, 1, 8) AS head,
         trim(concat('  ', c_mktsegment, '  ')) AS trimmed, concat_ws('-', c_name, c_mktsegment) AS joined,
         replace(c_name, 'Customer#', 'C') AS short, CAST(length(c_mktsegment) AS INTEGER) AS seg_len,
         lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, rpad(c_mktsegment, 12, '.') AS rpadded,
         lower(reverse(c_mktsegment)) AS rev
  FROM customer
""")
def q_s1(spark, sf):
    return S.string_funcs(table(spark, sf, "customer"))


@job("S2_regex", sql="""
  SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme,
         regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
         regexp_extract(url, '/([a-z]{2})/', 1) AS lang,
         regexp_replace(url, '[?#].*$', '') AS bare,
         regexp_matches(url, '[?&]page=[0-9]+') AS paged
  FROM pages
""")
def q_s2(spark, sf):
    return S.regex_funcs(table(spark, sf, "pages"))


@job("S3_date", sql="""
  SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m,
         CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(day(o_orderdate) AS INTEGER) AS dom,
         date_trunc('month', o_orderdate) AS month_start,
         CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS days_left,
         CAST(CAST(o_orderdate AS DATE) + 30 AS TIMESTAMP) AS due,
         CAST(last_day(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS month_end
  FROM orders
""")
def q_s3(spark, sf):
    return S.date_funcs(table(spark, sf, "orders"))


@job("S4_math", sql="""
  SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 3) AS r3,
         CAST(floor(l_extendedprice / 100) AS BIGINT) AS fl, CAST(ceil(l_extendedprice / 100) AS BIGINT) AS ce,
         round(ln(l_extendedprice), 6) AS ln_price, pow(l_quantity, 2) AS q2,
         round(sqrt(l_quantity), 6) AS sq, l_orderkey % 7 AS m7,
         l_extendedprice / NULLIF(l_quantity - l_quantity, 0) AS safe_div,
         abs(l_discount - 0.05) AS dev, CAST(sign(l_tax - 0.04) AS DOUBLE) AS sg
  FROM lineitem
""")
def q_s4(spark, sf):
    return S.math_funcs(table(spark, sf, "lineitem"))


@job("S5_conditional", sql="""
  SELECT c_custkey,
         CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS tier,
         coalesce(nullif(c_mktsegment, 'BUILDING'), 'B') AS seg,
         greatest(c_acctbal, 0.0) AS floor0, least(c_acctbal, 1000.0) AS cap1000,
         CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE c_name END AS odd_name
  FROM customer
""")
def q_s5(spark, sf):
    return S.conditional_funcs(table(spark, sf, "customer"))


@job("S6_array", sql="""
  SELECT page_id, CAST(len(parts) AS INTEGER) AS n_parts, parts[3] AS host,
         array_to_string(list_slice(parts, 2, 4), '|') AS mid,
         list_contains(parts, 'en') AS has_en,
         CAST(unnest(range(len(parts))) AS INTEGER) AS pos, unnest(parts) AS part
  FROM (SELECT page_id, string_split(url, '/') AS parts FROM pages)
""")
def q_s6(spark, sf):
    return S.array_funcs(table(spark, sf, "pages"))


@job("S7_higher_order", sql="""
  SELECT vec_id,
    round(sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b, 0.0::DOUBLE)), 6) AS norm,
    round(list_reduce(list_filter(v, lambda x: x > 0), lambda a, b: a + b, 0.0::DOUBLE), 6) AS pos_mass,
    round(list_reduce(list_transform(list_zip(v, list_reverse(v)), lambda p: p[1] * p[2]),
                      lambda a, b: a + b, 0.0::DOUBLE), 6) AS dot_rev,
    CAST(len(list_filter(v, lambda x: x > 0)) AS INTEGER) AS n_pos
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
""")
def q_s7(spark, sf):
    return S.higher_order_funcs(table(spark, sf, "embeddings"))


@job("S8_map_struct", sql="""
  SELECT l_orderkey, l_linenumber, m['q'] AS q, m['d'] AS d, CAST(cardinality(m) AS INTEGER) AS n_keys
  FROM (SELECT l_orderkey, l_linenumber,
               map_from_entries([('q', l_quantity), ('d', l_discount)]) AS m FROM lineitem)
""")
def q_s8(spark, sf):
    return S.map_struct_funcs(table(spark, sf, "lineitem"))


@job("S9_json", sql="""
  SELECT event_id, json_extract_string(props, '$.k') AS k_text,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events
""")
def q_s9(spark, sf):
    return S.json_funcs(table(spark, sf, "events"))


@job("S10_cast", sql="""
  SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio,
         CAST(TRY_CAST(o_orderpriority AS INTEGER) AS DOUBLE) AS bad,
         CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d,
         CAST(o_custkey AS VARCHAR) AS cust_text, o_totalprice AS round_trip
  FROM orders
""")
def q_s10(spark, sf):
    return S.cast_funcs(table(spark, sf, "orders"))


@job("udf_pandas", sql="""
  SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge
  FROM lineitem
""")
def q_udf_pandas(spark, sf):
    return U.line_charges(table(spark, sf, "lineitem"))


@job("udf_grouped", sql="""
  SELECT l_orderkey, l_linenumber,
         round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share
  FROM lineitem
""")
def q_udf_grouped(spark, sf):
    return U.line_shares(table(spark, sf, "lineitem"))


@job("udaf_pandas", sql="""
  SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS qty_spread
  FROM lineitem GROUP BY 1
""")
def q_udaf_pandas(spark, sf):
    return U.quantity_spread(table(spark, sf, "lineitem"))


@job("udtf_python", sql="""
  SELECT doc_id, CAST(generate_subscripts(parts, 1) AS INTEGER) AS line_no, unnest(parts) AS line,
         CAST(length(unnest(parts)) AS INTEGER) AS n_chars
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
""")
def q_udtf_python(spark, sf):
    return U.document_lines(table(spark, sf, "documents"))
