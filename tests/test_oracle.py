"""Every registered job against its DuckDB oracle at sf0.001 (the driver repeats this
at sf0.01); jobs without SQL must at least run and keep a stable schema."""

import pytest

from compare import same
from conftest import SF_SMALL
from quarry.plans import registry

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck_small, name):
    same(QUERIES[name](spark, SF_SMALL), duck_small.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_jobs_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0
    assert df.columns == QUERIES[name](spark, SF_SMALL).columns


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.columns == ["word", "n"]
    assert df.count() > 0
    assert set(e.queries()) >= set(QUERIES)
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["S3_date", "stream_tumbling", "win_range", "join_interval"])
def test_results_ignore_the_session_zone(spark, duck_small, name):
    """Naive timestamps are read as wall-clock times whatever the session zone: hourly
    stream windows, month starts, frames and gaps match SQL in a +05:30 zone too."""
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    spark.conf.set(key, "Asia/Kolkata")
    try:
        same(QUERIES[name](spark, SF_SMALL), duck_small.sql(ORACLE[name]))
    finally:
        spark.conf.set(key, old)
