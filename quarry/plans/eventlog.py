"""Per-stage summary of a Spark event log (what a history server shows, as a job).

The log must be plain JSON lines: ``spark.eventLog.rolling.enabled=false`` and
``spark.eventLog.compress=false``. Only the needed fields are declared, so the read
needs no schema-inference pass.

    python -m quarry.plans.eventlog <sf_dir> <log_dir> [<master>]

runs a WordCount over ``documents`` in a child application whose event log is written
to ``log_dir`` (used when the calling session has no readable log of its own).
"""

from __future__ import annotations

import glob
import os
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = """
  `Event` STRING, `Stage ID` BIGINT, `Stage Attempt ID` BIGINT,
  `Task Info` STRUCT<`Launch Time`: BIGINT, `Finish Time`: BIGINT, `Failed`: BOOLEAN>,
  `Task Metrics` STRUCT<`Executor Run Time`: BIGINT,
     `Shuffle Read Metrics`: STRUCT<`Remote Bytes Read`: BIGINT, `Local Bytes Read`: BIGINT>,
     `Shuffle Write Metrics`: STRUCT<`Shuffle Bytes Written`: BIGINT>>
"""


def event_log_summary(spark: SparkSession, log_path: str) -> DataFrame:
    """``stage_id, attempt, tasks, failed_tasks, run_ms, wall_ms, shuffle_read_bytes,
    shuffle_write_bytes`` from the SparkListenerTaskEnd events."""
    ev = spark.read.schema(LOG_SCHEMA).json(log_path)
    te = ev.where(F.col("Event") == "SparkListenerTaskEnd")
    ti, tm = F.col("`Task Info`"), F.col("`Task Metrics`")
    z = F.lit(0).cast("bigint")
    return (te.groupBy(F.col("`Stage ID`").alias("stage_id"),
                       F.col("`Stage Attempt ID`").alias("attempt"))
              .agg(F.count(F.lit(1)).alias("tasks"),
                   F.count(F.when(ti["Failed"], 1)).alias("failed_tasks"),
                   F.coalesce(F.sum(tm["Executor Run Time"]), z).alias("run_ms"),
                   F.coalesce(F.sum(ti["Finish Time"] - ti["Launch Time"]), z).alias("wall_ms"),
                   F.coalesce(F.sum(tm["Shuffle Read Metrics"]["Remote Bytes Read"] +
                                    tm["Shuffle Read Metrics"]["Local Bytes Read"]), z)
                    .alias("shuffle_read_bytes"),
                   F.coalesce(F.sum(tm["Shuffle Write Metrics"]["Shuffle Bytes Written"]), z)
                    .alias("shuffle_write_bytes")))


def own_log(spark: SparkSession) -> str | None:
    """The current application's log file, if it is being written as plain JSON."""
    try:
        conf = spark.sparkContext.getConf()
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect)
        return None
    if conf.get("spark.eventLog.enabled", "false").lower() != "true":
        return None
    if conf.get("spark.eventLog.compress", "false").lower() == "true":
        return None
    if conf.get("spark.eventLog.rolling.enabled", "false").lower() == "true":
        return None
    d = conf.get("spark.eventLog.dir", "/tmp/spark-events").rstrip("/")
    app = spark.sparkContext.applicationId
    if d.startswith("file:") or "://" not in d:
        local = d[5:] if d.startswith("file:") else d
        hits = glob.glob(os.path.join(local, app + "*"))
        return hits[0] if hits else None
    return f"{d}/{app}.inprogress"


def child_log(spark: SparkSession, sf_dir: str, log_dir: str,
              timeout_s: int | None = None) -> str:
    """Run a WordCount in a child application with a plain JSON event log in
    ``log_dir`` (any Hadoop path). The child uses the calling session's master, so on
    a cluster it runs on the cluster's executors like any other job. Spark needs the
    folder to exist; a one-line ``_marker`` write creates it on whatever file system
    the path names (readers skip names starting with ``_``)."""
    spark.createDataFrame([("event log folder",)], "value string") \
        .write.mode("overwrite").text(f"{log_dir.rstrip('/')}/_marker")
    master = spark.conf.get("spark.master", None) or "local[2]"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = dict(os.environ, PYTHONPATH=root + os.pathsep + os.environ.get("PYTHONPATH", ""))
    subprocess.run([sys.executable, "-m", "quarry.plans.eventlog", sf_dir, log_dir, master],
                   check=True, timeout=timeout_s, env=env,
                   stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    return log_dir


def _main(sf_dir: str, log_dir: str, master: str) -> None:
    from quarry.operators.text import word_count
    from quarry.session import get_session
    from quarry.sources.tables import table
    spark = get_session(master, app="quarry-eventlog-child", extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    word_count(table(spark, sf_dir, "documents"), "text").count()
    spark.stop()


if __name__ == "__main__":
    _main(sys.argv[1], sys.argv[2], sys.argv[3] if len(sys.argv) > 3 else "local[2]")
