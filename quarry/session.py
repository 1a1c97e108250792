"""One place that builds the SparkSession and knows where shared files go."""

from __future__ import annotations

import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE coalesces small shuffle partitions up to the
# advisory size and splits skewed join partitions; it never raises the partition count,
# so that count must be sized for the largest shuffle (see ``size_shuffle``).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.pyspark.fallback.enabled": "false",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.sql.streaming.forceDeleteTempCheckpointLocation": "true",
    # session windows: merge each map partition's rows into sessions before the
    # shuffle (the partial aggregation of session windows), so a hot user's rows of a
    # micro-batch do not all cross the network
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def get_session(master: str | None = None, partitions: int | None = None, app: str = "quarry",
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) the session. ``master`` is only set when given, so that
    ``spark-submit --master yarn ...`` keeps control on a cluster.

    ``partitions`` (shuffle partitions) defaults to three per core of the cluster,
    at least 16; ``size_shuffle`` raises the initial count for very large shuffles.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not partitions:
        cores = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.shuffle.partitions", str(max(16, 3 * cores)))
    shared_dir(spark)
    ship_package(spark)
    return spark


def size_shuffle(spark: SparkSession, shuffle_bytes: int, target_bytes: int = 128 << 20) -> int:
    """Size the initial shuffle partition count for ``shuffle_bytes`` of shuffle data,
    ``target_bytes`` per partition (so a partition sorts in executor memory); AQE then
    coalesces whatever turns out smaller. For example 30 TB of shuffle output gives
    about 240k partitions. Returns the count set."""
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(current, -(-shuffle_bytes // target_bytes))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    return n


def shuffle_partitions(spark: SparkSession) -> int:
    """The shuffle partition count in effect: ``spark.sql.shuffle.partitions``, or the
    larger initial count ``size_shuffle`` set for AQE. For code that picks a partition
    or bucket count itself (an explicit ``repartition(n, key)``, ``bucketBy``)."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(n, int(initial)) if initial else n


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by whoever submits the job (an HDFS / object-store
    path every executor can reach). When it is unset, a folder under the local temp
    folder serves a local master, as in tests; any other master is refused, since its
    executors could not see such a folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    if sc is None:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            d = _local_folder(spark.conf.get("spark.master", ""))
            spark.conf.set("spark.checkpoint.dir", d)
        return d
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = _local_folder(sc.master)
    sc.setCheckpointDir(d)
    # setCheckpointDir appends a per-application sub folder; report what Spark uses
    return sc.getCheckpointDir() or d


def _local_folder(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir is not set: with master {master!r} it must name a folder "
                           "that the driver and all executors share")
    return tempfile.mkdtemp(prefix="quarry-shared-")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, so that Python workers can import it wherever
    they run (as ``--py-files quarry.zip`` does)."""
    root = pathlib.Path(__file__).resolve().parent
    if root.parent.suffix == ".zip" or not root.is_dir():
        return  # came with --py-files
    target = pathlib.Path(tempfile.mkdtemp(prefix="quarry-package-")) / "quarry.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"quarry/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-before-used path under the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/quarry/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str):
    """Write ``df`` once as Parquet to a fresh path in the shared folder and return its
    read: computed exactly once however often it is read later, with lineage cut (a
    lost executor re-reads the files instead of recomputing the plan)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
