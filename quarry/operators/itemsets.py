"""Frequent itemsets by parallel FP-growth (Li et al., 2008): what is bought together."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quarry.session import materialize, shuffle_partitions

# Prefixes one group of items aims for: a group is mined by one Python call.
GROUP_ROWS = 200_000
# Items the prefixes of one Python call may hold: if some group can have more, those of over half
# of it are mined in slices of about a quarter.
PART_ITEMS = 2_000_000


class PrefixTree:
    """An FP-tree: transactions that begin alike share nodes. ``add`` takes a transaction
    whose items are in rank order."""

    def __init__(self):
        self.parent, self.item, self.count = [-1], [None], [0]
        self.child: dict = {}
        self.held: dict = {}   # item -> its nodes

    def add(self, items, n: int) -> None:
        at = 0
        for x in items:
            node = self.child.get((at, x))
            if node is None:
                node = self.child[at, x] = len(self.item)
                self.parent.append(at)
                self.item.append(x)
                self.count.append(0)
                self.held.setdefault(x, []).append(node)
            self.count[node] += n
            at = node

    def paths(self, x):
        """(items above, count) of each node of ``x``."""
        for node in self.held[x]:
            up, at = [], self.parent[node]
            while at:
                up.append(self.item[at])
                at = self.parent[at]
            yield up[::-1], self.count[node]

    def mine(self, min_count: int, max_size: int, only=None, suffix=()):
        """(items, count) of every frequent itemset whose last item by rank is in ``only``
        (any, if None), extended upwards through conditional trees."""
        for x, nodes in self.held.items():
            n = sum(self.count[i] for i in nodes)
            if n < min_count or only is not None and not only(x):
                continue
            found = (x, *suffix)
            yield found, n
            if len(found) == max_size:
                continue
            base = list(self.paths(x))
            support = Counter()
            for up, c in base:
                for y in up:
                    support[y] += c
            if len(found) + 1 == max_size:   # no tree needed for the last extension
                yield from (((y, *found), c) for y, c in support.items() if c >= min_count)
                continue
            tree = PrefixTree()
            for up, c in base:
                tree.add([y for y in up if support[y] >= min_count], c)
            yield from tree.mine(min_count, max_size, None, found)


def conditional_transactions(lines: DataFrame, basket: str, item: str, min_count: int, groups: int) -> DataFrame:
    """``part, prefix, n``: the transactions of each group of items, equal ones counted.

    Items in fewer than ``min_count`` baskets go first. The others are ranked by falling
    number of baskets and dealt to ``groups`` by a hash. A basket, sorted by rank, gives each
    group it has an item of one row: its items up to the last of that group. So a basket
    gives at most ``groups`` rows (and at most one per item), never its pairs; and the more
    frequent an item is, the fewer prefixes there are that end in it, so the count folds a
    hot item's rows in every task."""
    return _transactions(_basket_items(lines, basket, item), min_count, groups)


def _basket_items(lines: DataFrame, basket: str, item: str) -> DataFrame:
    held = lines.select(F.col(basket).alias("b"), F.col(item).alias("x")).where("b IS NOT NULL AND x IS NOT NULL").distinct()
    return materialize(held, "basket-items")


def _transactions(held: DataFrame, min_count: int, groups: int) -> DataFrame:
    support = held.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    ranked = held.join(support, "x").select("b", F.struct((-F.col("n")).alias("rank"), "x").alias("e"))
    sets = ranked.groupBy("b").agg(F.sort_array(F.collect_list("e")).alias("es")).where(F.size("es") > 1)
    sets = sets.select(F.transform("es", lambda e: e["x"]).alias("xs"))
    sets = sets.select("xs", F.transform("xs", lambda x: F.pmod(F.xxhash64(x), F.lit(groups))).alias("ps"))
    last = F.transform(F.array_distinct("ps"), lambda p: F.struct(
        p.alias("part"), F.slice("xs", F.lit(1), F.size("xs") - F.array_position(F.reverse("ps"), p).cast("int") + 1).alias("prefix")))
    return (sets.select(F.explode(last).alias("t")).select("t.part", "t.prefix").where(F.size("prefix") > 1)
                .groupBy("part", "prefix").agg(F.count(F.lit(1)).alias("n")))


def _most_items(held: DataFrame, min_count: int, groups: int) -> int:
    """No group has prefixes of more items than this: its items' baskets times the largest basket."""
    support = held.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    rows = support.groupBy(F.pmod(F.xxhash64("x"), F.lit(groups))).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    size = held.groupBy("b").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (rows or 0) * (size or 0)


def sliced(parts: DataFrame) -> DataFrame:
    """``parts`` with ``slice``, ``slices`` (of the group) and ``whole`` (its transactions): the
    prefixes of a group of more than half ``PART_ITEMS`` items are dealt to slices by a hash."""
    sizes = parts.groupBy("part").agg(F.sum(F.size("prefix")).alias("items"), F.sum("n").alias("whole"))
    sizes = sizes.select("part", "whole", F.when(F.col("items") <= PART_ITEMS // 2, F.lit(1)).otherwise(
        F.ceil(F.col("items") / F.lit(max(1, PART_ITEMS // 4)))).cast("long").alias("slices"))
    return parts.join(sizes, "part").withColumn("slice", F.pmod(F.xxhash64("prefix"), F.col("slices")))


def count_sets(prefixes, n, wanted) -> list[int]:
    """In how many of the transactions (``n`` of each prefix) each of the ``wanted`` itemsets is."""
    rows = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
    codes, items = pd.factorize(np.concatenate(list(prefixes)))
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(items)))
    held = {x: rows[order[a:b]] for x, a, b in zip(items.tolist(), [0, *ends[:-1]], ends)}
    n, none = np.asarray(n), rows[:0]
    counts = []
    for xs in wanted:
        first, *others = sorted((held.get(x, none) for x in xs), key=len)
        for other in others:
            first = first[np.isin(first, other)]
        counts.append(int(n[first].sum()))
    return counts


def _mine_slices(parts: DataFrame, min_count: int, max_size: int, kind) -> DataFrame:
    """The itemsets of groups of any size; no Python call holds more than a slice.

    Partition algorithm (Savasere et al., 1995): a frequent itemset has its share of
    ``min_count`` in at least one slice of its group, so each slice is mined for its share,
    and what was found is counted in all slices. If there are so many slices that the shares
    tell little, a slice returns all its counts instead, which are added up."""
    most = parts.agg(F.max("slices")).first()[0] or 1
    add_up = most * most > min_count

    def mine(rows: pd.DataFrame) -> pd.DataFrame:
        slices, least = int(rows["slices"].iloc[0]), min_count
        if slices > 1:
            least = 1 if add_up else -(-min_count * int(rows["n"].sum()) // int(rows["whole"].iloc[0]))
        found = _mined(rows, least, max_size)
        return pd.DataFrame([(rows["part"].iloc[0], *f) for f in found], columns=["part", "items", "freq"])

    def count(found: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(rows):
            return pd.DataFrame([], columns=["items", "freq"])
        return pd.DataFrame({"items": found["items"], "freq": count_sets(rows["prefix"], rows["n"], found["items"])})
    schema = StructType([StructField("items", ArrayType(kind)), StructField("freq", LongType())])
    counts = parts.groupBy("part", "slice").applyInPandas(mine, StructType([StructField("part", LongType()), *schema.fields]))
    if most > 1 and not add_up:
        found = materialize(counts.select("part", "items").distinct(), "found")
        slices = parts.select("part", F.col("slice").alias("at")).distinct()
        counts = (found.join(slices, "part").groupBy("part", "at")
                       .cogroup(parts.select("part", "slice", "prefix", "n").groupBy("part", "slice")).applyInPandas(count, schema))
    return counts.groupBy("items").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= min_count)


def _mined(rows: pd.DataFrame, min_count: int, max_size: int) -> list[tuple[list, int]]:
    tree, inside = PrefixTree(), set()
    for xs, ps, n in zip(rows["prefix"], rows["own"], rows["n"]):
        xs = xs.tolist()
        tree.add(xs, int(n))
        inside.update(x for x, own in zip(xs, ps) if own)
    return [(sorted(xs), n) for xs, n in tree.mine(min_count, max_size, inside.__contains__) if len(xs) > 1]


def frequent_itemsets(lines: DataFrame, basket: str, item: str, min_count: int = 2, max_size: int = 2,
                      groups: int | None = None) -> DataFrame:
    """``items`` (sorted), ``freq``: the sets of 2 to ``max_size`` items that occur together
    in at least ``min_count`` baskets, by parallel FP-growth (Li et al., 2008).

    Every group of items has its own conditional transactions, from which one prefix tree is
    built and mined for the itemsets whose least frequent item is in the group: the groups
    share nothing, and no list of items passes through the driver. There are as many groups
    as keep a group at about ``GROUP_ROWS`` rows of the input; the transactions of a hot item,
    which no number of groups divides, are mined in slices (``_mine_slices``). Rows with a null
    basket or item are left out; repeated rows count once."""
    spark = lines.sparkSession
    if groups is None:
        groups = max(shuffle_partitions(spark), -(-lines.count() // GROUP_ROWS))
    kind = lines.select(item).schema[0].dataType
    held = _basket_items(lines, basket, item)
    parts = _transactions(held, min_count, groups)
    own = F.transform("prefix", lambda x: F.pmod(F.xxhash64(x), F.lit(groups)) == F.col("part"))
    if _most_items(held, min_count, groups) > PART_ITEMS:
        parts = materialize(sliced(materialize(parts, "prefixes")).withColumn("own", own), "slices")
        return _mine_slices(parts, min_count, max_size, kind)

    def mine(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_mined(rows, min_count, max_size), columns=["items", "freq"])
    schema = StructType([StructField("items", ArrayType(kind)), StructField("freq", LongType())])
    return parts.withColumn("own", own).groupBy("part").applyInPandas(mine, schema)
