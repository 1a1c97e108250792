"""Band join against all pairs; the batch table function; audit statuses."""

import math
import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from quarry.functions import udfs
from quarry.operators import joins as J
from quarry.plans import registry

INF, NAN = float("inf"), float("nan")


@pytest.mark.parametrize("seed,levels", [(1, 20), (2, 3), (3, 0)])
def test_band_join_against_all_pairs(spark, monkeypatch, seed, levels):
    monkeypatch.setattr(J, "BAND_LEVELS", levels)
    r = random.Random(seed)
    pool = [0.0, -1.5, 2.0, 2.0, 1e-9, 1e12, -INF, INF, NAN, None, *[round(r.uniform(-50, 50), 1) for _ in range(60)]]
    rows = [(i, x) for i, x in enumerate(pool)]
    ends = [(r.choice(pool), r.choice(pool)) for _ in range(150)] + [(-INF, INF), (5.0, 5.0), (3.0, -3.0)]
    bands = [(100 + i, a, b) for i, (a, b) in enumerate(ends)]
    got = J.band_join(spark.createDataFrame(rows, "id int, v double"), "v", spark.createDataFrame(bands, "band int, lo double, hi double"), "lo", "hi")

    def less(a, b, or_equal):   # Spark's order: NaN above all
        if a is None or b is None:
            return False
        key = [(math.isnan(x), 0.0 if math.isnan(x) else x) for x in (a, b)]
        return key[0] < key[1] or or_equal and key[0] == key[1]
    want = sorted((i, b) for i, x in rows for b, lo, hi in bands
                  if x is not None and not math.isnan(x) and less(lo, x, True) and less(x, hi, False))
    assert sorted((g.id, g.band) for g in got.collect()) == want and want


def test_band_join_of_nothing(spark):
    rows, bands = spark.createDataFrame([], "id int, v double"), spark.createDataFrame([(1, 0.0, 1.0)], "band int, lo double, hi double")
    assert J.band_join(rows, "v", bands, "lo", "hi").count() == 0
    one = spark.createDataFrame([(1, 0.5)], "id int, v double")
    assert J.band_join(one, "v", bands.limit(0), "lo", "hi").count() == 0
    assert [(r.id, r.band) for r in J.band_join(one, "v", bands, "lo", "hi").collect()] == [(1, 1)]


def test_more_than_ten_thousand_bands_without_a_nested_loop(spark):
    bands = spark.range(20_000).select(F.col("id").alias("band"), F.col("id").cast("double").alias("lo"), (F.col("id") + 3).cast("double").alias("hi"))
    rows = spark.range(2000).select(F.col("id"), (F.col("id") * 10 + 0.5).alias("v"))
    j = J.band_join(rows, "v", bands, "lo", "hi")
    assert j.count() == 3 * 2000 - 2
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lines_of_texts(spark):
    df = spark.createDataFrame([(1, "a\nbb\n"), (2, None), (None, ""), (3, "é\r\n日本"), (2 ** 60 + 1, "x")], "doc_id long, text string").repartition(2)
    got = sorted(map(tuple, udfs.document_lines(df).collect()), key=repr)
    assert got == sorted([(1, 1, "a", 1), (1, 2, "bb", 2), (1, 3, "", 0), (None, 1, "", 0), (3, 1, "é\r", 2), (3, 2, "日本", 2),
                          (2 ** 60 + 1, 1, "x", 1)], key=repr)
    plan = udfs.document_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPython" not in plan


def test_audit_finds_every_kind_of_fault(spark):
    found = [r.status for r in registry.queries()["checksum_audit"](spark, SF_SMALL).collect()]
    assert {s: found.count(s) for s in set(found)} == {"valid": 12, "invalid": 1, "missing": 1, "bad_manifest": 1}
