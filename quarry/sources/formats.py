"""Table sources and sinks: Parquet, JSON lines, JDBC and catalog tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# --- Parquet -------------------------------------------------------------------------

# Rows per output file a partitioned write aims for (about 128-512 MB of Parquet for
# typical rows); a folder with more rows is written by several tasks.
ROWS_PER_FILE = 5_000_000


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = (),
                  mode: str = "error", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Parquet write, optionally partitioned into ``col=value`` folders.

    Rows are shuffled so that each task writes into few folders (bounded open files
    per task), but a folder is not tied to one task: every folder gets
    ``ceil(rows / rows_per_file)`` write slots, from one aggregation with a row per
    folder, and each row a slot by a hash of its values (deterministic, so a retried
    task rewrites the same rows). A folder holding a third of the data is thereby
    written by many tasks in parallel, a small one by one task into one file.
    """
    cols = list(partition_by)
    if not cols:
        df.write.mode(mode).parquet(path)
        return
    from quarry.plans.broadcast import small_side
    slots = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
               .select(*[F.col(c).alias("_k_" + c) for c in cols],
                       F.ceil(F.col("_n") / F.lit(rows_per_file)).alias("_slots")))
    slots = small_side(slots, "folder slots")
    cond = None
    for c in cols:
        eq = F.col(c).eqNullSafe(F.col("_k_" + c))
        cond = eq if cond is None else cond & eq
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    slotted = (df.join(slots, cond)
                 .withColumn("_slot", F.pmod(row_hash, F.col("_slots")))
                 .drop("_slots", *["_k_" + c for c in cols]))
    (slotted.repartition(*cols, "_slot").drop("_slot")
            .write.mode(mode).option("maxRecordsPerFile", rows_per_file)
            .partitionBy(*cols).parquet(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Folder names ``col=value`` become columns; filters on them prune folders."""
    return spark.read.parquet(path)


# --- JSON lines ----------------------------------------------------------------------

def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines with an explicit schema (no inference pass over the data), or with
    inference when ``schema`` is None (one extra full scan). Texts in the form
    ``write_json`` gives naive times are inferred as ``timestamp_ntz``."""
    r = spark.read.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if schema:
        return r.schema(schema).json(path)
    # which of the two timestamp types is inferred follows the session's default type
    kind = spark.conf.get("spark.sql.timestampType")
    spark.conf.set("spark.sql.timestampType", "TIMESTAMP_NTZ")
    try:
        return r.option("inferTimestamp", "true").json(path)
    finally:
        spark.conf.set("spark.sql.timestampType", kind)


# --- JDBC ----------------------------------------------------------------------------

def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "error",
               batch_size: int = 10_000) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_size)) \
        .mode(mode).save()


def read_jdbc(spark: SparkSession, url: str, table: str, partition_col: str,
              lower: int, upper: int, partitions: int) -> DataFrame:
    """Parallel JDBC read: ``partitions`` range queries on ``partition_col``. Filters
    and column pruning on the result are pushed into the generated SQL."""
    return (spark.read.format("jdbc")
                 .options(url=url, dbtable=table, partitionColumn=partition_col,
                          lowerBound=str(lower), upperBound=str(upper),
                          numPartitions=str(partitions), fetchsize="10000")
                 .load())


# --- catalog tables ------------------------------------------------------------------

def create_table(df: DataFrame, name: str, path: str | None = None, partition_by: Iterable[str] = ()) -> None:
    """Catalog table: managed (its files in ``spark.sql.warehouse.dir``, dropped with it),
    or external at ``path`` (a folder every executor can reach). With Hive support on, this
    is a Hive-metastore table; otherwise the session catalog."""
    w = df.write.format("parquet").mode("error")
    if path:
        w = w.option("path", path)
    cols = list(partition_by)
    if cols:
        w = w.partitionBy(*cols)
    w.saveAsTable(name)


def append_table(df: DataFrame, name: str) -> None:
    """``insertInto`` matches columns by position, so select in the table's order."""
    cols = df.sparkSession.table(name).columns
    df.select(*cols).write.insertInto(name)


# --- Arrow batches -------------------------------------------------------------------

def small_pandas(df: DataFrame, fn, schema: str, max_rows: int = 100_000) -> DataFrame:
    """``fn`` on a small result as one pandas frame, back as a DataFrame over Arrow. A frame
    over the row or byte bound of ``broadcast.fits`` is refused before it is fetched."""
    from quarry.plans.broadcast import fits
    if not fits(df, max_rows):
        raise ValueError(f"small_pandas: more than {max_rows} rows, or over the byte bound")
    return df.sparkSession.createDataFrame(fn(df.toPandas()), schema)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """Run ``fn(pandas.DataFrame) -> pandas.DataFrame`` on every Arrow batch of every
    partition (``mapInPandas``): no shuffle, batches of
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)
