"""Parallel FP-growth against counting every subset, and what its steps emit."""

import collections
import itertools
import random

import numpy as np
import pytest
from compare import same
from conftest import SF_CHECK, duck_for
from pyspark.sql import functions as F

from quarry.operators import itemsets
from quarry.operators.itemsets import PrefixTree, conditional_transactions, frequent_itemsets
from quarry.plans import registry


def brute(rows, min_count, max_size):
    baskets = collections.defaultdict(set)
    for b, x in rows:
        if b is not None and x is not None:
            baskets[b].add(x)
    n = collections.Counter(c for xs in baskets.values() for k in range(2, max_size + 1) for c in itertools.combinations(sorted(xs), k))
    return {c: f for c, f in n.items() if f >= min_count}


@pytest.mark.parametrize("groups,max_size,least", [(1, 2, 2), (7, 3, 3), (50, 4, 4)])
def test_itemsets_against_brute_force(spark, groups, max_size, least):
    r = random.Random(groups)
    rows = [(b, x) for b in range(150) for x in r.choices("abcdefghijklmnop", weights=range(1, 17), k=r.randint(1, 9))]
    rows += [(None, "a"), (3, None), (3, "a"), (3, "a")] + [(b, "hot") for b in range(150)]  # an item in every basket
    got = frequent_itemsets(spark.createDataFrame(rows, "b long, x string"), "b", "x", least, max_size, groups)
    found = {tuple(i.items): i.freq for i in got.collect()}
    assert found == brute(rows, least, max_size) and got.count() == len(found) > 20


def test_empty_and_single(spark):
    assert frequent_itemsets(spark.createDataFrame([], "b long, x long"), "b", "x").count() == 0
    assert frequent_itemsets(spark.createDataFrame([(1, 1), (2, 1)], "b long, x long"), "b", "x").count() == 0


def test_a_basket_gives_no_pairs(spark):
    """One basket with 2,000 items that no other has: pruned before anything is emitted. One whose
    items are all frequent gives a row per group, not its two million pairs."""
    alone = spark.range(2000).select(F.lit(1).alias("b"), F.col("id").alias("x"))
    assert conditional_transactions(alone, "b", "x", 2, 8).count() == 0
    twice = alone.unionByName(spark.range(2000).select((F.col("id") + 10).alias("b"), F.col("id").alias("x")))
    rows = conditional_transactions(twice, "b", "x", 2, 8).collect()
    assert len(rows) == 8 and sum(len(r.prefix) for r in rows) <= 8 * 2000


def test_hot_item_is_folded(spark):
    """The most frequent item, in all 5,000 baskets, leads every prefix and ends none."""
    rows = spark.range(5000).select(F.explode(F.array(F.lit(0).cast("long"), F.col("id") % 5 + 1)).alias("x"), F.col("id").alias("b"))
    got = conditional_transactions(rows, "b", "x", 2, 4).collect()
    assert {tuple(r.prefix): r.n for r in got} == {(0, k): 1000 for k in range(1, 6)}


def random_baskets(n):
    r = random.Random(n)
    return [(b, x) for b in range(n) for x in r.sample("abcdefghijkl", r.randint(6, 11))]


@pytest.mark.parametrize("least", [2, 60, 100])
def test_slices_against_brute_force(spark, monkeypatch, least):
    """Groups that are larger than one Python call may hold; with few and with many slices."""
    rows = random_baskets(300) + [(None, "a"), (3, None)]
    monkeypatch.setattr(itemsets, "PART_ITEMS", 1200)
    got = frequent_itemsets(spark.createDataFrame(rows, "b long, x string"), "b", "x", least, 3, 5).collect()
    assert {tuple(r.items): r.freq for r in got} == brute(rows, least, 3) and len(got) > 20
    assert all(r.items == sorted(r.items) for r in got)


def test_a_slice_does_not_grow_with_the_baskets(spark, monkeypatch):
    """Few items in ever more baskets: one group has nearly all prefixes, a slice of it does not."""
    monkeypatch.setattr(itemsets, "PART_ITEMS", 1000)
    for n in (300, 1200):
        parts = conditional_transactions(spark.createDataFrame(random_baskets(n), "b long, x string"), "b", "x", 2, 5)
        held = itemsets.sliced(parts).groupBy("part", "slice").agg(F.sum(F.size("prefix")).alias("n")).collect()
        assert max(r.n for r in held) <= 1000 < sum(r.n for r in held) and len({r.part for r in held}) <= 5


def test_counted_sets():
    prefixes = [np.array(list(x)) for x in ("abc", "abd", "b", "cd")]
    assert itemsets.count_sets(prefixes, [1, 2, 4, 8], ["ab", "b", "cd", "abc", "ad", "xa"]) == [3, 7, 8, 1, 2, 0]


def test_prefix_tree_shares_nodes():
    tree = PrefixTree()
    tree.add("abc", 2)
    tree.add("abd", 1)
    assert len(tree.item) == 5 and dict(tree.mine(2, 3)) == {
        ("a",): 3, ("b",): 3, ("c",): 2, ("a", "b"): 3, ("a", "c"): 2, ("b", "c"): 2, ("a", "b", "c"): 2}


@pytest.mark.parametrize("name", ["ml_frequent_items", "ml_frequent_itemsets"])
def test_jobs_against_sql(spark, monkeypatch, name):
    monkeypatch.setattr(itemsets, "GROUP_ROWS", 3000)
    same(registry.queries()[name](spark, SF_CHECK), duck_for(SF_CHECK).sql(registry.oracle_sql()[name]))


def test_plan_has_no_pair_join(spark):
    """No self join of the lines: the only joins are with the table of supports."""
    job = registry.queries()["ml_frequent_items"]
    plan = job(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("FlatMapGroupsInPandas") == 1 and "Expand" not in plan
