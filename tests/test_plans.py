"""Physical-plan properties that matter at scale, checked on every registered job."""

import pytest

from conftest import SF_SMALL
from quarry.plans import registry

QUERIES = registry.queries()


def plan_of(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan_of(spark, n) for n in QUERIES}


def test_no_cartesian_products(plans):
    assert [n for n, p in plans.items() if "CartesianProduct" in p] == []


def test_no_nested_loop_join(plans):
    assert [n for n, p in plans.items() if "BroadcastNestedLoopJoin" in p] == []


def test_no_row_at_a_time_python(plans):
    assert [n for n, p in plans.items() if "BatchEvalPython" in p] == []
    assert "ArrowEvalPythonUDTF" in plans["udtf_python"]


def test_filters_pushed_and_columns_pruned(plans):
    p = plans["project_filter"]
    assert "PushedFilters: [IsNotNull(l_quantity)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double," in p
    assert "l_tax" not in p and "l_partkey" not in p


def test_expected_words_filtered_before_the_shuffle(plans):
    p = plans["expected_counts"]
    # the semi-join against the broadcast expectation list sits below the partial count
    partial = p.index("partial_count")
    assert "LeftSemi" in p[partial:]


def test_top_n_trims_before_the_shuffle(plans):
    assert "WindowGroupLimit" in plans["win_topn"] and "Partial" in plans["win_topn"]
    assert "WindowGroupLimit" in plans["win_first_last"]


def test_global_top_k_is_take_ordered(plans):
    assert "TakeOrderedAndProject" in plans["sort_limit_topk"]


def test_word_count_aggregates_partially(plans):
    assert "partial_count" in plans["word_count"]


def test_dimensions_broadcast(plans):
    assert plans["join_broadcast"].count("BroadcastExchange") >= 2


def test_sequence_windows_partition_by_user(plans):
    # small inputs fit one range: a plain window per user, no stitching join
    for name in ("win_lag_lead", "win_running", "win_range", "join_asof"):
        assert "hashpartitioning(user_id" in plans[name], name


def test_split_sequence_windows_partition_by_key_and_range(spark):
    """Beyond one range (forced here by a tiny row target) every window is over
    (user, range): no task ever holds one user's whole sequence."""
    from pyspark.sql import functions as F

    from quarry.operators import joins as J
    from quarry.operators import windows as W
    from quarry.sources.tables import table

    e = table(spark, SF_SMALL, "events").select("event_id", "user_id", "ts", "value")
    p = e.where(F.col("value") > 100)
    built = {
        "lag_lead": W.lag_lead(e, "user_id", "ts", "event_id", ["ts"], target_rows=50),
        "running": W.running_total(e, "user_id", "ts", "event_id", "value", target_rows=50),
        "trailing": W.trailing_range(e, "user_id", "ts", "value", 3600, target_rows=50),
        "asof": J.asof_join(e, p, "user_id", "ts", ["event_id"], target_rows=50),
    }
    for name, df in built.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        windows = [ln for ln in plan.splitlines() if "Window [" in ln and "_b" in ln]
        assert windows, name
        assert all("user_id" in ln for ln in windows), name


def test_graph_rounds_never_shuffle_the_edges(spark):
    """The per-round join of vertex state to the bucketed edge table shuffles only the
    state (broadcasts off, as for a large state at scale)."""
    from pyspark.sql import functions as F

    from quarry.operators import graph as G
    from quarry.sources.tables import table

    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        e = G.edge_table(G.consecutive_line_edges(table(spark, SF_SMALL, "lineitem")), "plan-edges")
        state = table(spark, SF_SMALL, "part").select(F.col("p_partkey").alias("src"),
                                                      F.lit(1.0).alias("pr"))
        j = e.join(state, "src").groupBy("dst").agg(F.sum("pr"))
        lines = j._jdf.queryExecution().executedPlan().toString().splitlines()
        scan = next(i for i, ln in enumerate(lines) if "Bucketed: true" in ln)

        def depth(ln):
            return len(ln) - len(ln.lstrip(" :+-"))
        # ancestors of the edge scan, nearest first, up to the join that consumes it
        path, d = [], depth(lines[scan])
        for ln in reversed(lines[:scan]):
            if depth(ln) < d:
                path.append(ln.strip(" :+-"))
                d = depth(ln)
                if "Join" in ln:
                    break
        assert path and "Join" in path[-1], path
        assert not any(x.startswith("Exchange") for x in path), path
    finally:
        spark.conf.set(key, old)
