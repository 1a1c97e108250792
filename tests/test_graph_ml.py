"""Graph jobs on hand-made graphs with known answers, and ML sanity checks."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.operators import graph as G
from quarry.operators import ml as M
from quarry.sources.tables import table


@pytest.fixture(scope="module")
def g(spark):
    # triangle 1-2-3, tail 3-4, separate edge 5-6, isolated 7
    v = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (5, 6)], "src long, dst long")
    return v, e


def test_components(g):
    got = {r["id"]: r["component"] for r in G.connected_components(*g).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}


def _union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {i: min(j for j in range(n) if find(j) == find(i)) for i in range(n)}


@pytest.mark.parametrize("shape", ["chain", "random"])
def test_components_against_union_find(spark, shape):
    """A long chain (label propagation would need a round per two hops) with the ids
    shuffled, and a sparse random graph with many components."""
    import random
    rnd = random.Random(7)
    n = 300
    if shape == "chain":
        order = list(range(n))
        rnd.shuffle(order)
        pairs = list(zip(order, order[1:]))
    else:
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(220)]
    edges = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
    v = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {r["id"]: r["component"] for r in G.connected_components(v, e).collect()}
    assert got == _union_find(n, edges)


def test_triangles_and_open_wedges(g):
    t = {r["id"]: r["triangles"] for r in G.triangle_counts(*g).collect()}
    assert t == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}
    w = {r["id"]: r["open_wedges"] for r in G.open_two_hop(*g).collect()}
    # vertex 3 has neighbours 1, 2, 4: pairs (1,4) and (2,4) are open, (1,2) is closed
    assert w == {1: 0, 2: 0, 3: 2, 4: 0, 5: 0, 6: 0, 7: 0}


def test_pagerank_sums_to_one(g):
    pr = G.pagerank(*g, iterations=20)
    assert abs(pr.agg(F.sum("pr")).first()[0] - 1.0) < 1e-9
    d = {r["id"]: r["pr"] for r in pr.collect()}
    assert d[3] > d[1] == pytest.approx(d[2]) and d[5] == pytest.approx(d[6])


def test_bfs(g):
    got = {(r["landmark"], r["id"]): r["hops"] for r in G.bfs_hops(*g, [1, 5]).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 2, (5, 5): 0, (5, 6): 1}


def test_degrees(g):
    got = {r["id"]: (r["out_deg"], r["in_deg"], r["degree"]) for r in G.degrees(*g).collect()}
    assert got[3] == (1, 2, 3) and got[7] == (0, 0, 0)


def test_kmeans_assigns_every_vector(spark):
    emb = table(spark, SF_SMALL, "embeddings")
    out = M.kmeans(emb, "vec_id", "embedding", k=4)
    assert out.count() == emb.count()
    assert out.select("cluster").distinct().count() <= 4


def test_logistic_auc_is_probability(spark):
    out = M.logistic_quality(table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels"))
    r = out.agg(F.min("auc").alias("a"), F.count(F.lit(1)).alias("n")).first()
    assert 0.0 <= r["a"] <= 1.0 and r["n"] > 0
