"""A hub with a third of all edges: its edges are dealt to several buckets; triangles keep one
row per edge between steps."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph as G


@pytest.fixture(scope="module")
def hub(spark):
    r = random.Random(2)
    pairs = {(0, i) for i in range(1, 301)}
    while len(pairs) < 900:
        a, b = sorted(r.sample(range(1, 320), 2))
        pairs.add((a, b))
    return spark.range(325).select("id"), spark.createDataFrame(sorted(pairs), "src long, dst long"), pairs


def test_a_hub_is_cut(spark, hub):
    _, e, pairs = hub
    cut = G.cut_edges(e, "test-cut", hub_edges=30)
    degree = collections.Counter(x for p in pairs for x in p)
    assert {r.src: r.parts for r in cut.hubs.collect()} == {x: -(-d // 30) for x, d in degree.items() if d > 30}
    assert cut.edges.count() == 1800 and {r.src: r.deg for r in cut.degree.collect()} == dict(degree)
    most = cut.edges.groupBy("src", "part").count().agg(F.max("count")).first()[0]
    assert degree[0] == 300 and most <= 60   # hashed: about 30 each
    state = cut.replicated(spark.createDataFrame([(0, 1.0), (5, 2.0)], "src long, c double"))
    assert sorted((r.src, r.part) for r in state.collect()) == [(0, i) for i in range(10)] + [(5, 0)]


def test_results_do_not_depend_on_the_cut(hub):
    v, e, pairs = hub
    a = {r.id: r.pr for r in G.pagerank(v, e, 4).collect()}
    b = {r.id: r.pr for r in G.pagerank(v, e, 4, hub_edges=30).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-12 for i in a) and abs(sum(a.values()) - 1) < 1e-9
    near = collections.defaultdict(set)
    for x, y in pairs:
        near[x].add(y)
        near[y].add(x)
    want, level, hops = {}, {0}, 0
    while level:
        want |= {(0, x): hops for x in level}
        level, hops = {y for x in level for y in near[x]} - {x for _, x in want}, hops + 1
    got = {(r.landmark, r.id): r.hops for r in G.bfs_hops(v, e, [0], hub_edges=30).collect()}
    assert got == want


def test_edges_of_a_cut_table_never_move(spark, hub):
    _, e, _ = hub
    cut = G.cut_edges(e, "plan-cut", hub_edges=30)
    state = cut.degree.select("src", (1.0 / F.col("deg")).alias("c"))
    j = cut.edges.join(cut.replicated(state).hint("shuffle_hash"), ["src", "part"])
    lines = j._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, ln in enumerate(lines) if "Bucketed: true" in ln)
    depth = [len(ln) - len(ln.lstrip(" :+-")) for ln in lines]
    d = depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < d:
            assert "Exchange" not in lines[i]
            d = depth[i]


def test_triangles_without_wedges(spark, hub):
    _, e, pairs = hub
    have = set(pairs)
    want = {(a, b, c) for a, b in pairs for c in range(b + 1, 320) if (b, c) in have and (a, c) in have}
    t = G.triangles(e)
    got = [tuple(r) for r in t.collect()]
    assert sorted(got) == sorted(want) and len(want) > 20
    assert "array_intersect" in t._jdf.queryExecution().optimizedPlan().toString()
    near = G._oriented(e).groupBy("u").count().agg(F.max("count")).first()[0]
    assert near <= (2 * len(pairs)) ** 0.5
    assert list(itertools.islice((x for x in got if not x[0] < x[1] < x[2]), 1)) == []
