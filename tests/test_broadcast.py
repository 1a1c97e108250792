"""The broadcast guard: rows and bytes are both bounded, and the probe is bounded."""

from conftest import SF_SMALL
from quarry.plans.broadcast import fits, probe, small_side
from quarry.sources.tables import table


def test_small_dimension_is_broadcast(spark):
    nation = table(spark, SF_SMALL, "nation")
    assert probe(nation)[0] == 25
    assert fits(nation)
    plan = nation.join(small_side(table(spark, SF_SMALL, "nation")), "n_nationkey")
    assert "broadcast" in plan._jdf.queryExecution().analyzed().toString().lower()


def test_row_bound(spark):
    customer = table(spark, SF_SMALL, "customer")      # 150 rows
    assert fits(customer, max_rows=150)
    assert not fits(customer, max_rows=149)
    assert small_side(customer, max_rows=10) is customer


def test_byte_bound_catches_few_wide_rows(spark):
    docs = table(spark, SF_SMALL, "documents")          # 200 rows of long text
    n, b = probe(docs)
    assert n == 200 and b > 200 * 100
    assert fits(docs, max_rows=1000)
    assert not fits(docs, max_rows=1000, max_bytes=b - 1)
    assert small_side(docs, max_rows=1000, max_bytes=1 << 10) is docs


def test_probe_stops_at_the_row_bound(spark):
    li = table(spark, SF_SMALL, "lineitem")
    assert probe(li, max_rows=99)[0] == 100
