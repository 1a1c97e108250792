"""Jobs the deployment really runs (WordCount, result checks, digests, SparkPi)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import text
from quarry.plans.registry import job
from quarry.session import materialize, scratch_path
from quarry.sources.tables import table

# Words a deployment's smoke and preflight checks count.
GOLDEN_WORDS = [("hadoop", 2), ("spark", 1), ("preflight", 2)]
TOP_WORDS = 50
ABSENT_STATE = "X"

_WORDS_SQL = r"""
  SELECT w AS word FROM (
    SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS w FROM documents
  ) WHERE w <> ''
"""


def _values_sql(rows, cols, alias):
    vals = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return f"(VALUES {vals}) AS {alias}({', '.join(cols)})"


@job("word_count", sql=f"SELECT word, count(*) AS n FROM ({_WORDS_SQL}) GROUP BY word")
def q_word_count(spark, sf):
    return text.word_count(table(spark, sf, "documents"), "text")


@job("word_count_sink", sql=f"SELECT word, count(*) AS n FROM ({_WORDS_SQL}) GROUP BY word")
def q_word_count_sink(spark, sf):
    counts = text.word_count(table(spark, sf, "documents"), "text")
    return text.word_count_sink(counts, scratch_path(spark, "wordcount-out"))


@job("expected_counts", sql=f"""
  WITH counts AS MATERIALIZED (SELECT word, count(*) AS n FROM ({_WORDS_SQL}) GROUP BY word),
  top AS MATERIALIZED (SELECT word, n AS expected FROM counts ORDER BY n DESC, word LIMIT {TOP_WORDS}),
  e AS (SELECT * FROM top
        UNION ALL SELECT * FROM {_values_sql(GOLDEN_WORDS, ['word', 'expected'], 'g')}
        WHERE word NOT IN (SELECT word FROM top))
  SELECT e.word, CAST(e.expected AS BIGINT) AS expected, CAST(c.n AS DOUBLE) AS n,
         CASE WHEN c.n IS NULL THEN 'missing' WHEN c.n = e.expected THEN 'ok'
              ELSE 'mismatch' END AS status
  FROM e LEFT JOIN counts c USING (word)
""")
def q_expected_counts(spark, sf):
    """An expectations file (the most frequent words as counted by SQL text, and the golden
    words) is written, read and checked against the word count."""
    docs, path = table(spark, sf, "documents"), scratch_path(spark, "expectations")
    view = "docs_" + path.rsplit("-", 1)[-1]
    docs.createOrReplaceTempView(view)
    top = spark.sql(f"""SELECT word, count(*) AS expected FROM {view}
                        LATERAL VIEW explode(regexp_extract_all(text, '[^ \\\\t\\\\n\\\\r\\\\f]+', 0)) AS word
                        GROUP BY word ORDER BY expected DESC, word LIMIT {TOP_WORDS}""")
    top = materialize(top, "top-words")   # read twice below, counted once
    golden = spark.createDataFrame(GOLDEN_WORDS, "word string, expected bigint")
    top.unionByName(golden.join(top.select("word"), "word", "left_anti")).write.json(path)
    spark.catalog.dropTempView(view)
    exp = spark.read.schema("word string, expected bigint").json(path)
    counts = text.word_count(docs, "text")
    # n is null for missing words: DOUBLE on both sides keeps the pandas dtypes equal
    return text.expected_counts(counts, exp).withColumn("n", F.col("n").cast("double"))


@job("word_count_chain", sql=f"SELECT word, count(*) AS n, 'ok' AS status FROM ({_WORDS_SQL}) GROUP BY word")
def q_word_count_chain(spark, sf):
    """The whole text pipeline: put the texts into a folder, count the words of the files,
    write the sorted counts, read them back and check every one against the table."""
    from quarry.sources.files import text_landing
    docs = table(spark, sf, "documents")
    lines = text_landing(docs, scratch_path(spark, "chain-in"), "text")
    counts = text.word_count_sink(text.word_count(lines, "value"), scratch_path(spark, "chain-out"))
    expected = text.word_count(docs, "text").withColumnRenamed("n", "expected")
    checked = text.expected_counts(counts, expected)
    return checked.select("word", "n", "status")


@job("state_count_check", sql=f"""
  WITH c AS (SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1),
  e AS (SELECT state, n AS expected FROM c UNION ALL SELECT '{ABSENT_STATE}', 0)
  SELECT e.state, CAST(e.expected AS BIGINT) AS expected, coalesce(c.n, 0) AS n,
         coalesce(c.n, 0) = e.expected AS ok
  FROM e LEFT JOIN c USING (state)
""")
def q_state_count_check(spark, sf):
    """Expectations from another route (counts per state and priority, summed), written to a
    file and read back, plus a state that never occurs."""
    orders, path = table(spark, sf, "orders"), scratch_path(spark, "state-expectations")
    per = orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    exp = per.groupBy(F.col("o_orderstatus").alias("state")).agg(F.sum("n").alias("expected"))
    absent = spark.createDataFrame([(ABSENT_STATE, 0)], "state string, expected bigint")
    exp.unionByName(absent).write.json(path)
    return text.state_count_check(orders, "o_orderstatus",
                                  spark.read.schema("state string, expected bigint").json(path))


@job("row_checksum", sql="""
  SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_key
  FROM documents GROUP BY 1
""")
def q_row_checksum(spark, sf):
    return text.row_checksum(table(spark, sf, "documents"), "doc_id", "text")


# --- SparkPi over table rows: each lineitem row seeds one point, so the sample grows
# with the data. Row id = l_orderkey * 16 + l_linenumber (unique per line).
_PI_SQL = """
  WITH ids AS (SELECT l_orderkey * 16 + l_linenumber AS id FROM lineitem),
  xy AS (SELECT id, ((id % 2147483648) * 1103515245 + 12345) % 2147483648 AS x FROM ids),
  p AS (SELECT x - 1073741824 AS u,
               ((x * 1103515245 + 12345) % 2147483648) - 1073741824 AS v FROM xy)
  SELECT count(*) AS n,
         CAST(sum(CASE WHEN u * u + v * v <= 1152921504606846976 THEN 1 ELSE 0 END) AS BIGINT) AS inside,
         4 * CAST(sum(CASE WHEN u * u + v * v <= 1152921504606846976 THEN 1 ELSE 0 END) AS DOUBLE)
           / count(*) AS pi
  FROM p
"""


@job("pi_estimate", sql=_PI_SQL)
def q_pi_estimate(spark, sf):
    from quarry.operators.montecarlo import pi_from_ids
    li = table(spark, sf, "lineitem")
    return pi_from_ids(li.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id")))


@job("text_landing", sql="SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def q_text_landing(spark, sf):
    from quarry.sources.files import text_landing
    return text_landing(table(spark, sf, "documents"), scratch_path(spark, "landing"), "text")


@job("file_inventory")
def q_file_inventory(spark, sf):
    from quarry.sources.files import file_inventory
    return file_inventory(spark, sf, "*.parquet").select("name", "size")


@job("checksum_audit")
def q_checksum_audit(spark, sf):
    """Publish a manifest of the table files in which one digest is altered, one file is left
    out and one is listed that does not exist; then audit the files against it."""
    from quarry.sources import files
    found = files.file_digests(spark, sf, "*.parquet")
    ends = found.agg(F.min("file").alias("first"), F.max("file").alias("last")).first()
    listed = found.where(F.col("file") != ends["last"])
    listed = listed.select("file", F.when(F.col("file") == ends["first"], F.sha2("actual", 512)).otherwise(F.col("actual")).alias("actual"))
    absent = spark.range(1).select(F.lit(f"{ends['last']}.absent").alias("file"), F.sha2(F.lit("absent"), 512).alias("actual"))
    path = scratch_path(spark, "manifest")
    files.write_manifest(listed.unionByName(absent), path)
    return files.checksum_audit(files.file_digests(spark, sf, "*.parquet"), files.read_manifest(spark, path))
