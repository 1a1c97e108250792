"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed by and sorted on the digest of the normalised
text: one row per distinct text ever seen, with the id that stands for it. A new batch is
folded to one row per digest (map-side first, so a group of copies of any size reaches
the shuffle as one row per task), looked up in the index by a sort-merge anti-join that
shuffles only the batch (the index is already bucketed), and what is new is appended.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space.

Edge cases: a null text counts as empty (all empty texts are one group); a null id sorts
after every other id; of repeated rows with the same id and text one stays (the least by its
other columns); an empty batch adds nothing; extra columns are passed through by
``deduplicate`` whatever their names. Appending a batch again adds nothing and returns the same ids, so a job that lost
its driver between append and result can simply be run again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.frames import col, tie_break
from quarry.session import materialize, scratch_path, shuffle_partitions

SPACES = "[\\x20\\x09-\\x0D]+"


def digest(text):
    """SHA-256 (32 bytes) of the normalised text."""
    return F.unhex(F.sha2(F.encode(normal(text), "UTF-8"), 256))


def normal(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class DigestIndex:
    """``path``: where the index lives (shared storage); kept between runs. ``buckets``
    is fixed when the index is made: about the bytes of all digests over 128 MB."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        n = buckets or shuffle_partitions(spark)
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{path}'")

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        """Forget the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame) -> None:
        """Add the digests of ``batch`` (digest, keep_id; one row per digest) that the
        index does not hold."""
        new = batch.select("digest", "keep_id").join(
            self.table().select("digest").hint("merge"), "digest", "left_anti")
        # the files read by the anti-join are the table written to: fix the rows first
        materialize(new, "digest-new").write.insertInto(self.name)


def resolve(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Append ``docs`` to the index and return one row per input row: ``id``, ``keep_id``
    (the id that stands for the text: the one in the index if the text was known before,
    else the smallest of the batch), ``group_size`` (equal rows in this batch), ``kept``,
    ``digest``. The texts are read once; only ids and digests are written and shuffled."""
    rows = materialize(docs.select(col(id_col).cast("bigint").alias("id"),
                                   digest(col(text_col)).alias("digest"),
                                   F.monotonically_increasing_id().alias("row")), "digests")
    groups = rows.groupBy("digest").agg(
        F.min("id").alias("batch_id"), F.count(F.lit(1)).alias("group_size"),
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    groups = materialize(groups, "digest-groups")
    index.append(groups.select("digest", F.col("batch_id").alias("keep_id")))
    held = index.table().hint("merge")
    known = groups.join(held, "digest").select(
        "digest", held["keep_id"], "group_size", F.col("first.row").alias("first_row"),
        (held["keep_id"].eqNullSafe(F.col("batch_id"))).alias("own"))
    # read from plain files, not from the bucketed index: both sides of the next join are
    # then shuffled, and Spark can split the rows of a text with many copies
    known = materialize(known, "digest-known")
    return (rows.join(known, "digest")
                .select("id", "keep_id", "group_size",
                        (F.col("own") & (F.col("row") == F.col("first_row"))).alias("kept"), "digest"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. With ``index``, texts it
    holds are dropped as well and the others are appended.

    One shuffle: ``min_by`` folds the copies of a text in each map task first, so only one
    row per text and task is moved."""
    d, r, k = "digest", "doc", "rank"
    id_ = F.col(r).getField(id_col)
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(r))
    packed = packed.select(digest(F.col(r).getField(text_col)).alias(d), r,
                           F.struct(id_.isNull().alias("none"), id_.alias("id"),
                                    tie_break(docs, r, (id_col, text_col)).alias("rest")).alias(k))
    kept = packed.groupBy(d).agg(F.min_by(r, k).alias(r))
    if index is not None:
        kept = materialize(kept.join(index.table().select(d).hint("merge"), d, "left_anti"), "dedup-new")
        index.append(kept.select(d, F.col(r).getField(id_col).cast("bigint").alias("keep_id")))
    return kept.select(*[F.col(r).getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """op7: every row of ``docs`` resolved against a fresh index in the shared folder."""
    with DigestIndex(spark, scratch_path(spark, "digest-index")) as index:
        out = materialize(resolve(docs, index), "dedup-result")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
  WITH h AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
  ), g AS (
    SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY 1
  )
  SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
  FROM h JOIN g USING (text_sha256)
"""
