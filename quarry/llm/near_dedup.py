"""Near-duplicate classes by ProbMinHash, banding and verification.

Shingles are runs of five words (``[^\\x20\\x09-\\x0D]+``; a shorter text is one shingle),
weighted by how often they occur in the text. The similarity of two texts is the
probability Jaccard similarity of their weighted shingles (Moulton and Jiang 2018; plain
Jaccard where no shingle repeats), and texts are linked from 0.8.

*Signature* (ProbMinHash, Ertl 2020). Each shingle is a Poisson process whose rate is its
weight; its points arrive at exponential gaps hashed from the shingle and fall on one of
``K`` registers. A register keeps the shingle whose point arrived first, so two texts
agree in a register with probability equal to their similarity. Points after the time by
which all registers are filled cannot win, so a process stops there (early termination):
about K ln K points are made for a text of any length, besides one per shingle.

*Banding.* ``BANDS`` bands of ``ROWS`` registers; at similarity 0.8 a pair meets in some
band with probability 1 - (1 - 0.8**6)**32 = 0.99994.

*Verification without all pairs.* Texts with the same shingles and weights are one node.
Verified links are joined into classes; a pair of one class needs no further test.

1. In each bucket every node is compared with the least node.
2. In each bucket that still holds several classes, the nodes of other classes are
   compared with the node that has most links (in a group of edited copies that is the
   text they were made from).
3. Nodes that still share a bucket with another class go through an exact prefix join
   (``prefix_pairs``): their shingles are ordered from rare to frequent, and a pair is compared
   only if it meets in a shingle that lies early enough in both orders for 0.8 to be possible.

*The bound of the prefix join.* Let P and Q be the shares of the two texts' weights that lie
on shingles of both. The larger of two ratios is at least their mean, and the weighted harmonic
mean is superadditive, so the similarity is at most 1 / (1/P + 1/Q - 1), with equality where no
shingle repeats. At 0.8 this asks for 1/P + 1/Q <= 2.25. What stands before the first common
shingle is not common: with shares M and N before it, P <= 1 - M and Q <= 1 - N, so both are at
most 1/5 and one of them is at most 1/9. The common weights of the two texts differ by no more
than their repeats, which bounds P by Q and the lengths, and the other way round. Edited copies
that are all a little below the threshold each begin with a ninth of shingles of their own, so
they do not meet at all.

No step is capped, and none emits all pairs of a bucket. (Texts of many classes that are mostly
made of the same passages, none of which is rare, do meet in those.)

Edge cases: a null, empty or blank text has no shingles and is a class of its own; a null
id sorts after all others; repeated rows are one class, of which one row is kept (the least
by its other columns); an
empty table gives an empty result; extra columns are ignored by ``classes`` and kept by
``deduplicate``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.arrowtext import Texts, mix, powers, texts, windows, word_hashes
from quarry.llm.frames import col, map_arrow, tie_break
from quarry.session import materialize

WORDS, MIN_SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
K = BANDS * ROWS
# what 1/P + 1/Q may be at the least similarity; shares before a shingle: in both texts, in one of them
LIMIT = 1 + 1 / MIN_SIMILARITY
LONG, SHORT = 1 - 1 / (LIMIT - 1), 1 - 2 / LIMIT
# shares are sums in doubles: pairs right at a bound stay
SLACK = 1e-9
#: Shingles in one Arrow batch of ``occurrences``.
SLICE = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_REGISTER = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(t: Texts, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 54-bit shingle, count), sorted, each shingle of a text once."""
    doc, starts, ends = t.words()
    hashes = word_hashes(t.buf, starts, ends)
    at, h = windows(doc, hashes, k)
    docs, hs = [doc[at]], [h]
    n_words = np.bincount(doc, minlength=t.n)
    short = n_words[doc] < k
    if short.any():
        d, w = doc[short], hashes[short]
        for n in range(1, k):
            at, h = windows(d, w, n)
            whole = n_words[d[at]] == n
            docs.append(d[at][whole])
            hs.append(h[whole])
    key = np.sort(np.concatenate(docs).astype(np.uint64) << np.uint64(54) | np.concatenate(hs) >> np.uint64(10))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(54)).astype(np.int64), key & np.uint64((1 << 54) - 1), count


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """ProbMinHash signatures (n x k) of n texts; texts without shingles stay 0."""
    total = np.bincount(doc, weights=weight, minlength=n)
    best = np.full(n * k, np.inf)
    won = np.zeros(n * k, dtype=np.uint64)
    horizon = np.zeros(n)
    np.divide(k * (np.log(k) + 3.0), total, out=horizon, where=total > 0)
    todo = total > 0
    while todo.any():
        horizon_e = np.where(todo, horizon, 0.0)[doc]
        mine = np.flatnonzero(horizon_e > 0)
        _arrivals(doc[mine], h[mine], weight[mine].astype(float), horizon_e[mine], k, best, won)
        # all points up to the horizon were seen: a filled register is final
        todo &= ~np.isfinite(best).reshape(n, k).all(axis=1)
        horizon *= 2
    return won.reshape(n, k)


def _arrivals(doc, h, weight, horizon, k, best, won) -> None:
    """Let the points of every process up to its horizon compete for the registers."""
    time = np.zeros(len(h))
    i, block = 0, 1
    while len(h):
        step = (np.arange(i, i + block, dtype=np.uint64) + np.uint64(1)) * _STEP
        r = mix((h[:, None] ^ step[None, :]).ravel()).reshape(len(h), block)
        gaps = -np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / weight[:, None]
        at = time[:, None] + np.cumsum(gaps, axis=1)
        e, j = np.nonzero(at <= horizon[:, None])
        slot = doc[e] * k + (mix(r[e, j] ^ _REGISTER) % np.uint64(k)).astype(np.int64)
        t = at[e, j]
        np.minimum.at(best, slot, t)
        first = best[slot] == t
        won[slot[first]] = h[e[first]]
        more = at[:, -1] <= horizon
        doc, h, weight, horizon, time = doc[more], h[more], weight[more], horizon[more], at[more, -1]
        i += block
        block = 1 if i < 6 else 32


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit bucket key per band."""
    n, k = sig.shape
    parts = sig.reshape(n, bands, k // bands)
    key = np.zeros((n, bands), dtype=np.uint64)
    for j, p in enumerate(powers(_STEP, k // bands)):
        key += mix(parts[:, :, j] + np.uint64(j)) * p
    return mix(key + np.arange(1, bands + 1, dtype=np.uint64) * _REGISTER)


def _bounds(doc: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(n + 1))


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text_key, bag, keys): ``text_key`` names the text, ``bag`` its
    weighted shingles (null without any), ``keys`` its bucket of each band."""
    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            for t in texts(batch.column(3)):
                doc, h, count = shingles(t)
                keys = band_keys(signatures(doc, h, count, t.n))
                at = _bounds(doc, t.n)
                bags = [hashlib.blake2b(h[a:b].tobytes() + count[a:b].tobytes(), digest_size=16).digest()
                        if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
                offs = np.arange(0, BANDS * t.n + 1, BANDS, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(t.first, t.n) for i in range(3)), pa.array(bags, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(offs), pa.array(keys.view(np.int64).ravel()))],
                    names=["row", "doc_id", "text_key", "bag", "keys"])
        return fn
    text = F.coalesce(col(text_col), F.lit(""))
    return map_arrow(
        docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).cast("bigint").alias("doc_id"),
                    F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("text_key"), text.alias("text")),
        make, "row long, doc_id long, text_key binary, bag binary, keys array<long>")


def bags(nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, h, count, total): the weighted shingles of the nodes' texts as binary arrays
    (``count`` empty if all are 1) and the sum of the weights. One shuffle of the texts, copies
    folded first."""
    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            for t in texts(batch.column(1)):
                doc, h, count = shingles(t)
                at = _bounds(doc, t.n)
                hs = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                cs = [count[a:b].tobytes() if b > a and count[a:b].max() > 1 else b""
                      for a, b in zip(at[:-1], at[1:], strict=True)]
                total = np.bincount(doc, weights=count, minlength=t.n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.first, t.n), pa.array(hs, pa.binary()), pa.array(cs, pa.binary()), pa.array(total)],
                    names=["node", "h", "count", "total"])
        return fn
    text = F.coalesce(col(text_col), F.lit(""))
    whole = (docs.select(F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("text_key"), text.alias("text"))
                 .groupBy("text_key").agg(F.first("text").alias("text")))
    return map_arrow(whole.join(nodes, "text_key").select("node", "text"), make,
                     "node long, h binary, count binary, total long")


def occurrences(bag: DataFrame) -> DataFrame:
    """(node, shingle, weight): one row per shingle of each node."""
    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            nodes, hs, cs, held = [], [], [], 0

            def rows():
                n = [len(h) for h in hs]
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(nodes, np.int64), n)), pa.array(np.concatenate(hs).view(np.int64)),
                     pa.array(np.concatenate(cs))], names=["node", "shingle", "weight"])
            for i in range(batch.num_rows):
                h, c = batch.column(1)[i].as_buffer(), batch.column(2)[i].as_buffer()
                nodes.append(batch.column(0)[i].as_py())
                hs.append(np.frombuffer(h, np.uint64))
                cs.append(np.frombuffer(c, np.int64) if c.size else np.ones(len(hs[-1]), np.int64))
                held += len(hs[-1])
                if held >= SLICE:
                    yield rows()
                    nodes, hs, cs, held = [], [], [], 0
            if nodes:
                yield rows()
        return fn
    return map_arrow(bag.select("node", "h", "count"), make, "node long, shingle long, weight long")


def similarity(ha: np.ndarray, ca: np.ndarray | None, hb: np.ndarray, cb: np.ndarray | None) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted ids, counts or None
    for all 1): sum over common d of 1 / sum over d' of max(x_d'/x_d, y_d'/y_d).

    Ordered by x/y, the maximum is the x part from d on and the y part before it, so one
    sort and two running sums give all the inner sums."""
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if ca is None and cb is None:
        return len(common) / (len(ha) + len(hb) - len(common))
    xa = np.ones(len(ha)) if ca is None else ca.astype(float)
    yb = np.ones(len(hb)) if cb is None else cb.astype(float)
    x, y = xa[ia], yb[ib]
    only_x, only_y = xa.sum() - x.sum(), yb.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    from_here = np.searchsorted(ratio, ratio, side="left")
    above = np.append(np.cumsum(x[::-1])[::-1], 0.0)[from_here] + only_x
    below = np.append(0.0, np.cumsum(y))[from_here] + only_y
    return float((1.0 / (above / x + below / y)).sum())


def compare(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose similarity is at least ``MIN_SIMILARITY``."""
    def make() -> Callable:
        def fn(batch: pa.RecordBatch):
            cols = [batch.column(i) for i in range(6)]
            sims = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                ha, ca, hb, cb = (cols[j][i].as_buffer() for j in range(2, 6))
                sims[i] = similarity(np.frombuffer(ha, np.uint64), np.frombuffer(ca, np.int64) if ca.size else None,
                                     np.frombuffer(hb, np.uint64), np.frombuffer(cb, np.int64) if cb.size else None)
            ok = pa.array(sims >= MIN_SIMILARITY)
            yield pa.RecordBatch.from_arrays([cols[0].filter(ok), cols[1].filter(ok), pa.array(sims).filter(ok)],
                                             names=["a", "b", "similarity"])
        return fn
    left = bag.select(F.col("node").alias("a"), F.col("h").alias("ha"), F.col("count").alias("ca"))
    right = bag.select(F.col("node").alias("b"), F.col("h").alias("hb"), F.col("count").alias("cb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "ca", "hb", "cb")
    return map_arrow(both, make, "a long, b long, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(node, class) of the nodes with links: least node of the component. Each round
    takes the least label of the neighbours, then the label of that label; it runs until
    nothing changes."""
    edges = materialize(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                                       F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e"))
                             .select("e.u", "e.v"), "edges")
    label = materialize(edges.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("node"), F.least("u", "v").alias("class")), "labels")
    while True:
        # own label and those of the neighbours, in one aggregation
        heard = edges.join(label, edges["v"] == label["node"]).select(F.col("u").alias("node"), "class", F.lit(None).cast("long").alias("old"))
        own = label.select("node", "class", F.col("class").alias("old"))
        near = own.unionByName(heard).groupBy("node").agg(F.min("class").alias("class"), F.max("old").alias("old"))
        jump = label.select(F.col("node").alias("class"), F.col("class").alias("far"))
        new = materialize(near.join(jump, "class").select("node", "old", F.least("class", "far").alias("class")), "labels")
        label = new.select("node", "class")
        if new.where(F.col("old") != F.col("class")).isEmpty():
            return label


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of pairs (x, y)."""
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _open(members: DataFrame, classes_: DataFrame) -> DataFrame:
    """(key, node, class) of the members of buckets that hold several classes."""
    held = members.join(classes_, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class"))
    mixed = held.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    return held.join(mixed.select("key"), "key")


def hub_pairs(held: DataFrame, links: DataFrame) -> DataFrame:
    """(x, y): the node of each bucket with most links, and its nodes of other classes."""
    degree = (links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    ranked = held.join(degree, "node", "left").select(
        "key", "node", "class", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), (-F.col("node")).alias("order"),
                                         F.col("class").alias("of")).alias("rank"))
    hub = ranked.groupBy("key").agg(F.max("rank").alias("hub"))
    return ranked.join(hub, "key").where(F.col("class") != F.col("hub.of")).select(
        (-F.col("hub.order")).alias("x"), F.col("node").alias("y"))


def prefix_entries(held: DataFrame, bag: DataFrame) -> DataFrame:
    """(shingle, node, class, ahead, total, excess) of the shingles in which a node may meet a
    similar node of another class first. ``ahead``: the share of its weight on rarer shingles,
    ``excess``: its weight beyond 1 per shingle.

    A shingle stays if it is at most ``LONG`` ahead, several classes have it, and the node is at
    most ``SHORT`` ahead or long enough for some node that is."""
    own = bag.join(held.select("node", "class").distinct(), "node")
    rows = materialize(occurrences(own), "occurrences")
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    node = Window.partitionBy("node")
    order = node.orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = rows.join(often, "shingle").select(
        "node", "shingle", (F.sum("weight").over(order) - F.col("weight") - F.sum("weight").over(node)).alias("from_end"))
    sizes = own.select("node", "class", "total", (F.col("total") - F.octet_length("h") / 8).alias("excess"))
    entries = materialize(
        shared.join(sizes, "node").withColumn("ahead", (F.col("total") + F.col("from_end")) / F.col("total"))
              .where(F.col("ahead") <= LONG + SLACK).drop("from_end"), "entries")
    short = F.col("ahead") <= SHORT + SLACK
    met = entries.groupBy("shingle").agg(
        F.min("class").alias("lo"), F.max("class").alias("hi"),
        F.min(F.when(short, F.col("total") - LIMIT / 2 * F.col("excess"))).alias("shortest")).where("lo <> hi")
    reach = (LIMIT * (1 - F.col("ahead")) - 1) * F.col("total") + SLACK * F.col("total")
    return entries.join(met, "shingle").where(short | (F.col("shortest") <= reach)).drop("lo", "hi", "shortest")


def prefix_pairs(held: DataFrame, bag: DataFrame) -> DataFrame:
    """(x, y): nodes of different classes that can be similar, by the bound of the prefix join.
    A shingle's most frequent class meets its other classes only, never itself."""
    entries = materialize(prefix_entries(held, bag), "entries")
    most = (entries.groupBy("shingle", "class").agg(F.count(F.lit(1)).alias("n"))
                   .groupBy("shingle").agg(F.max(F.struct("n", "class")).alias("most"))
                   .select("shingle", F.col("most.class").alias("main")))
    at = entries.join(most, "shingle")
    x = at.where("class <> main").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("node", "class", "ahead", "total", "excess")])
    y = at.select("shingle", "main", *[F.col(c).alias(f"{c}_y") for c in ("node", "class", "ahead", "total", "excess")])

    def share(a: str, b: str) -> Column:
        """The most of a's weight that can be common to a and b."""
        common = (1 - F.col(f"ahead_{b}")) * F.col(f"total_{b}") + F.col(f"excess_{a}")
        return F.least(1 - F.col(f"ahead_{a}"), common / F.col(f"total_{a}"))
    near = 1 / share("x", "y") + 1 / share("y", "x") <= LIMIT + SLACK
    once = (F.col("class_y") == F.col("main")) | (F.col("node_x") < F.col("node_y"))
    return x.join(y, (x["shingle"] == y["shingle"]) & (F.col("class_x") != F.col("class_y")) & once & near).select(
        F.col("node_x").alias("x"), F.col("node_y").alias("y"))


def _apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are of different classes, with these (u, v)."""
    def of(node: str, class_: str) -> DataFrame:
        return linked.select(F.col("node").alias(node), F.col("class").alias(class_))
    both = pairs.join(of("a", "u"), "a", "left").join(of("b", "v"), "b", "left")
    return both.withColumn("u", F.coalesce("u", "a")).withColumn("v", F.coalesce("v", "b")).where("u <> v")


def merge(linked: DataFrame, links: DataFrame) -> DataFrame:
    """(node, class) after the classes that ``links`` connect are joined. Links become pairs of
    classes, each once: what is inside a class is not looked at again."""
    between = _apart(links, linked).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    joined = components(between)
    alone = joined.select("node", F.col("node").alias("class")).join(linked, "node", "left_anti")
    far = joined.select(F.col("node").alias("class"), F.col("class").alias("far"))
    return materialize(linked.unionByName(alone).join(far, "class", "left")
                             .select("node", F.coalesce("far", "class").alias("class")), "labels")


def nearest(met: DataFrame) -> DataFrame:
    """Of the pairs (a, b, n), for each node the one that meets in most shingles: one per node."""
    ends = met.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y"), "n"),
                                        F.struct(F.col("b").alias("x"), F.col("a").alias("y"), "n"))).alias("e")).select("e.*")
    best = ends.groupBy("x").agg(F.max(F.struct("n", (-F.col("y")).alias("order"))).alias("best"))
    return _ordered(best.select("x", (-F.col("best.order")).alias("y")))


def link_classes(members: DataFrame, bag: DataFrame) -> DataFrame:
    """(node, class) of linked nodes, from bucket members (key, node, leader)."""
    star = members.where("node <> leader").select(F.col("leader").alias("x"), F.col("node").alias("y"))
    tested = materialize(_ordered(star), "pairs")
    links = materialize(compare(tested, bag), "links")
    linked = components(links)
    held = materialize(_open(members, linked), "open")
    if held.isEmpty():
        return linked
    new = materialize(_ordered(hub_pairs(held, links)).join(tested, ["a", "b"], "left_anti"), "pairs")
    found = materialize(compare(new, bag), "links")
    if not found.isEmpty():
        linked = merge(linked, found)
        held = materialize(_open(members, linked), "open")
        if held.isEmpty():
            return linked
    met = (prefix_pairs(held, bag).groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                                  .agg(F.count(F.lit(1)).alias("n")))
    met = materialize(met.join(tested.union(new), ["a", "b"], "left_anti"), "pairs")
    first = materialize(nearest(met), "pairs")
    found = materialize(compare(first, bag), "links")
    if not found.isEmpty():
        linked = merge(linked, found)
        met = _apart(met, linked).select("a", "b")
    rest = materialize(met.select("a", "b").join(first, ["a", "b"], "left_anti"), "pairs")
    found = materialize(compare(rest, bag), "links")
    return linked if found.isEmpty() else merge(linked, found)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (least id of its class),
    ``class_size``, ``kept`` (one row of each class), ``text_key``."""
    rows = materialize(sign(docs, id_col, text_col), "signatures")
    nodes = materialize(
        rows.where("bag IS NOT NULL").groupBy("bag").agg(F.min("text_key").alias("text_key"), F.first("keys").alias("keys"))
            .withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    members = materialize(keyed.join(shared.select("key", "leader"), "key"), "members")
    candidates = members.select("node").distinct().join(nodes.select("node", "text_key"), "node")
    linked = link_classes(members, materialize(bags(candidates, docs, text_col), "bags"))
    node_of = nodes.select("bag", "node").join(linked, "node", "left").select("bag", F.coalesce("class", "node").alias("class"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    placed = rows.select("row", "doc_id", "text_key", "bag").join(node_of, "bag", "left")
    placed = materialize(placed.select("row", "doc_id", "text_key", "class"), "placed")
    whole = (placed.where("class IS NOT NULL").groupBy("class")
                   .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("class_size")))
    return (placed.join(whole, "class", "left")
                  .select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
                          F.coalesce("class_size", F.lit(1)).alias("class_size"),
                          F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"), "text_key"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents kept, one of each class, with all their columns."""
    def name(id_, text_key):
        return F.md5(F.encode(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("none")), F.hex(text_key)), "UTF-8"))

    kept = classes(docs, id_col, text_col).where("kept").select(name(F.col("doc_id"), F.col("text_key")).alias("k"))
    key = F.unhex(F.md5(F.encode(F.coalesce(col(text_col), F.lit("")), "UTF-8")))
    packed = docs.select(name(col(id_col).cast("bigint"), key).alias("k"),
                         F.struct(*[col(c) for c in docs.columns]).alias("doc"))
    one = packed.join(kept, "k", "left_semi").groupBy("k").agg(
        F.min_by("doc", tie_break(docs, "doc", (id_col, text_col))).alias("doc"))
    return one.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
