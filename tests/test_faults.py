"""Faults found in review, each with the smallest input that shows it."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from conftest import ROOT
from quarry import session
from quarry.functions import udfs
from quarry.operators import aggregates as A
from quarry.operators import graph as G
from quarry.sources import files
from quarry.streaming import streams as S

BIG = 2 ** 53


def test_integer_keys_stay_exact_beside_nulls(spark):
    rows = [(BIG, 1.0), (BIG + 1, 9.0), (BIG, 2.0), (None, 5.0), (None, 7.0), (BIG + 1, None)]
    got = udfs.quantity_spread(spark.createDataFrame(rows, "l_orderkey long, l_quantity double").coalesce(1)).collect()
    assert {r.l_orderkey: r.qty_spread for r in got} == {BIG: 1.0, BIG + 1: 0.0, None: 2.0}
    folded = (spark.createDataFrame(rows, "user_id long, value double").coalesce(1)
                   .mapInArrow(S._fold_batches, S.PARTIAL).collect())
    assert {r.user_id: (r.n, r.total) for r in folded} == {BIG: (2, 3.0), BIG + 1: (2, 9.0), None: (2, 12.0)}


def test_landed_text_keeps_other_line_ends(spark):
    df = spark.createDataFrame([("a\rb\nc",), ("x\x85y",)], "t string")
    lines = [r.value for r in files.text_landing(df, session.scratch_path(spark, "landing-test"), "t").collect()]
    assert sorted(lines) == ["a\rb", "c", "x\x85y"]


def test_audit_tells_files_of_one_name_apart(spark, tmp_dir):
    for d in ("x", "y"):
        os.makedirs(os.path.join(tmp_dir, "in", d))
        with open(os.path.join(tmp_dir, "in", d, "p.bin"), "w") as f:
            f.write(d)
    found = files.file_digests(spark, os.path.join(tmp_dir, "in"))
    files.write_manifest(found, os.path.join(tmp_dir, "m"))
    got = files.checksum_audit(found, files.read_manifest(spark, os.path.join(tmp_dir, "m"))).collect()
    assert sorted((r.file, r.status) for r in got) == [("x/p.bin", "valid"), ("y/p.bin", "valid")]


def test_pagerank_of_nothing(spark):
    v, e = spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long")
    assert G.pagerank(v, e).collect() == []


def test_a_long_chain_is_complete(spark):
    n = 12
    v = spark.range(n + 1)
    e = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.id: r.hops for r in G.bfs_hops(v, e, [0]).collect()} == {i: i for i in range(n + 1)}
    assert {r.component for r in G.connected_components(v, e).collect()} == {0}


@pytest.mark.parametrize("master, ok", [("yarn", False), ("spark://h:7077", False), ("local-cluster[2,1,1024]", False),
                                        ("local", True), ("local[4]", True), ("local[*]", True)])
def test_no_local_folder_on_a_cluster(master, ok):
    if ok:
        assert os.path.isdir(session._local_folder(master))
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session._local_folder(master)


def test_quantiles_by_ranges(spark, monkeypatch):
    from quarry.operators import windows
    rows = [("a", float(i * i % 37)) for i in range(50)] + [("b", 4.0), ("b", 1.0), ("c", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {r.k: (r.p25, r.p50, r.p75) for r in df.groupBy("k").agg(
        *[F.percentile("v", p).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)]).collect()}
    for target in (windows.TARGET_ROWS, 7):
        monkeypatch.setattr(windows.range_cuts, "__defaults__", (target, None))
        got = {r.k: (r.p25, r.p50, r.p75) for r in A.quantiles(df, ["k"], "v", [0.25, 0.5, 0.75]).collect()}
        assert got == want


def test_lists_come_in_chunks(spark):
    df = spark.range(25).select(F.lit(1).alias("k"), (24 - F.col("id")).alias("v"))
    got = {r.chunk: r["items"] for r in A.sorted_list(df, ["k"], "v", size=10).collect()}
    assert got == {i: ",".join(map(str, range(10 * i, min(25, 10 * i + 10)))) for i in range(3)}


def test_python_workers_find_the_package_from_any_folder(tmp_dir):
    """Started elsewhere with the repository on ``sys.path`` alone, workers import the
    package that ``get_session`` ships."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "from quarry.session import get_session\nfrom quarry.functions import udfs\n"
            "s = get_session('local[2]', 2)\n"
            "df = s.createDataFrame([(1, 1, 2.0)], 'l_orderkey long, l_linenumber int, l_extendedprice double')\n"
            "print('SHARE', udfs.line_shares(df).first().share)\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, env=env, capture_output=True, text=True, timeout=300)
    assert "SHARE 1.0" in out.stdout, out.stderr[-2000:]
