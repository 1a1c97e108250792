"""Text and result-audit jobs: the work the deployment's own smoke checks run.

word counting, writing counts as ``word<TAB>n``, checking expected counts, checking a
state count, and per-record digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.broadcast import small_side

# The token delimiters of the classic WordCount tokenizer
# (space, tab, line feed, carriage return, form feed), written as a Java regex class.
WORD_DELIMITERS = r"[ \t\n\r\f]+"


def tokens(df: DataFrame, text_col: str) -> DataFrame:
    """One row per token (``word``); case and punctuation kept, empty tokens dropped."""
    return (df.select(F.explode(F.split(F.col(text_col), WORD_DELIMITERS)).alias("word"))
              .where(F.col("word") != ""))


def word_count(df: DataFrame, text_col: str = "value") -> DataFrame:
    """``word string, n bigint``.

    explode -> HashAggregate(partial) -> Exchange(word) -> HashAggregate(final): each
    map task folds its own copies of a hot word into one row before the shuffle, so a
    word holding a third of all tokens costs one row per task, not a third of the data.
    """
    return tokens(df, text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def format_counts(counts: DataFrame) -> DataFrame:
    """``word<TAB>n`` lines, the WordCount output format."""
    return counts.select(F.concat_ws("\t", "word", F.col("n").cast("string")).alias("value"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.col("value"), "\t")
    return (spark.read.text(path)
                 .select(parts.getItem(0).alias("word"), parts.getItem(1).cast("bigint").alias("n")))


def word_count_sink(counts: DataFrame, path: str) -> DataFrame:
    """Write counts sorted by word as ``word<TAB>n`` text into a new folder (mode
    ``error``: an existing output folder is refused, as the reference's job does), and
    read them back.

    The global sort range-partitions on ``word`` (sampled bounds), so output files are
    ordered part by part without funnelling the data through one task.
    """
    format_counts(counts.orderBy("word")).write.mode("error").text(path)
    return read_counts(counts.sparkSession, path)


def expected_counts(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """``word, expected, n, status`` for every expected (word, count); extra words in
    ``counts`` are allowed. status: ``ok`` | ``mismatch`` | ``missing``.

    ``expected`` is a short list, so it is broadcast (size checked) into a semi-join.
    Catalyst pushes that semi-join below the aggregation, so only expected words are
    shuffled and counted.
    """
    exp = expected.select("word", F.col("expected").cast("bigint").alias("expected"))
    wanted = small_side(exp.select("word"), "expected words")
    found = counts.join(wanted, "word", "left_semi")
    out = exp.join(found, "word", "left")
    status = (F.when(F.col("n").isNull(), F.lit("missing"))
               .when(F.col("n") == F.col("expected"), F.lit("ok"))
               .otherwise(F.lit("mismatch")))
    return out.select("word", "expected", "n", status.alias("status"))


def state_count_check(df: DataFrame, state_col: str, expected: DataFrame) -> DataFrame:
    """``state, expected, n, ok``: rows per state compared with an expected number
    (exact). A state absent from ``df`` counts 0. ``expected`` holds
    ``(state, expected)``. The expectation list is the preserved side of the outer join,
    so it streams; the counts (one row per state, after partial aggregation) are the
    build side, and AQE broadcasts them from their runtime size."""
    counts = (df.groupBy(F.col(state_col).alias("state"))
                .agg(F.count(F.lit(1)).alias("n")))
    exp = expected.select("state", F.col("expected").cast("bigint").alias("expected"))
    out = exp.join(counts, "state", "left")
    n = F.coalesce(F.col("n"), F.lit(0).cast("bigint"))
    return out.select("state", "expected", n.alias("n"), (n == F.col("expected")).alias("ok"))


def row_checksum(df: DataFrame, key_col: str, value_col: str) -> DataFrame:
    """``h, n, first_key``: SHA-256 of each record's value, grouped. ``n > 1`` marks exact
    copies; ``first_key`` is the smallest key holding that content. Partial aggregation
    keeps a heavily copied record to one row per map task before the shuffle."""
    return (df.select(F.sha2(F.col(value_col), 256).alias("h"), F.col(key_col).alias("k"))
              .groupBy("h")
              .agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_key")))
