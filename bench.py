"""Benchmark: run every registered job at $BENCH_SF_DIR on local[$BENCH_CPUS] and print
one JSON line.

Each job is executed in full through the ``noop`` sink (every row computed, nothing
collected to the driver) after two warm-up jobs (a WordCount, and a trivial pandas map
that starts the Python workers). ``value`` is the sum of per-job wall
times in seconds. BENCH_ONLY=name1,name2 restricts the run.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans import registry  # noqa: E402
from quarry.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    log_dir = tempfile.mkdtemp(prefix="quarry-bench-eventlog-")
    spark = get_session(f"local[{cpus}]", max(8, 2 * cpus), app="quarry-bench", extra={
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    jobs = registry.queries()
    names = only or list(jobs)
    # warm-up, not counted: JVM class loading, and one Python worker per core with
    # pandas/Arrow imported (a one-time cost per executor, not per job)
    jobs["word_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 64 * cpus, numPartitions=cpus).mapInPandas(
        lambda it: (b for b in it), "id long").write.format("noop").mode("overwrite").save()
    times, failed = {}, {}
    for n in names:
        t0 = time.perf_counter()
        try:
            jobs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir).replace("sf", "")
    out = {"metric": "sum_of_job_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
           "cpus": cpus, "jobs": len(times)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
