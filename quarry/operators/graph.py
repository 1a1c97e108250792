"""Graph jobs over vertex / edge DataFrames (``id``; ``src``, ``dst`` with
``src < dst``, undirected).

Iterative jobs write the mirrored edge list once into the shared folder as a bucketed
table (``cut_edges``). Every round joins the vertex-sized state (ranks, a frontier) to it: the
state is shuffled into the buckets, the edge list never moves again. The edges of a hub are
dealt to several buckets (a vertex cut), and its state goes to each of them. Round results are written as Parquet into the shared folder
(``_Rounds``): each round is computed once, lineage stays a few rounds deep, and a
lost executor costs at most the rounds since the last write.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.broadcast import small_side
from quarry.session import materialize, scratch_path, shuffle_partitions

SAVE_EVERY = 3


def edge_table(edges: DataFrame, name: str = "edges") -> DataFrame:
    """Both directions of ``edges`` as a table bucketed by ``src`` (as many buckets as
    shuffle partitions) in the shared folder, read back through the catalog so joins
    on ``src`` see the bucketing."""
    spark = edges.sparkSession
    n = shuffle_partitions(spark)
    path = scratch_path(spark, name)
    tname = f"quarry_{name.replace('-', '_')}_{path.rsplit('-', 1)[-1]}"
    (mirrored(edges).repartition(n, "src").write.bucketBy(n, "src")
        .option("path", path).saveAsTable(tname))
    return spark.table(tname)


# Edges of a vertex one bucket may hold; a vertex with more is cut.
HUB_EDGES = 1_000_000


class CutEdges(NamedTuple):
    """``edges``: both directions as ``src, part, dst``, bucketed by (``src``, ``part``).
    ``degree``: ``src, deg`` of every vertex with edges. ``hubs``: ``src, parts`` of the cut ones."""

    edges: DataFrame
    degree: DataFrame
    hubs: DataFrame

    def replicated(self, state: DataFrame) -> DataFrame:
        """``state`` (a row or more per ``src``) with ``part``: the rows of a hub once for each
        part of its edges, those of other vertices once."""
        parts = F.sequence(F.lit(0), (F.coalesce("parts", F.lit(1)) - 1).cast("int"))
        return state.join(small_side(self.hubs), "src", "left").withColumn("part", F.explode(parts)).drop("parts")


def cut_edges(edges: DataFrame, name: str = "edges", hub_edges: int | None = None) -> CutEdges:
    """Both directions of ``edges`` as a table in the shared folder, bucketed by ``src`` and, for
    vertices with more than ``hub_edges`` edges, by a hash of ``dst`` as well: no bucket holds
    more of a vertex, whatever its degree. There are at most 2 * edges / ``hub_edges`` hubs."""
    spark = edges.sparkSession
    bound = hub_edges or HUB_EDGES
    n = shuffle_partitions(spark)
    both = mirrored(edges)
    degree = materialize(both.groupBy("src").agg(F.count(F.lit(1)).alias("deg")), name + "-degree")
    hubs = materialize(degree.where(F.col("deg") > bound).select("src", F.ceil(F.col("deg") / bound).alias("parts")), name + "-hubs")
    part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int")
    path = scratch_path(spark, name)
    tname = f"quarry_{name.replace('-', '_')}_{path.rsplit('-', 1)[-1]}"
    (both.join(small_side(hubs), "src", "left").select("src", part.alias("part"), "dst")
         .repartition(n, "src", "part").write.bucketBy(n, "src", "part").option("path", path).saveAsTable(tname))
    return CutEdges(spark.table(tname), degree, hubs)


class _Rounds:
    """Writes round results as Parquet into the shared folder, alternating two paths:
    the round being written only reads the other one, so disk holds two rounds."""

    def __init__(self, spark, name: str):
        self.spark = spark
        self.paths = [scratch_path(spark, name + "-a"), scratch_path(spark, name + "-b")]
        self.i = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = self.paths[self.i % 2]
        self.i += 1
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def consecutive_line_edges(lineitem: DataFrame) -> DataFrame:
    """Undirected part-part edges: the different parts of two consecutive lines of one
    order (line numbers ``n`` and ``n + 1``); stored once with ``src < dst``.

    An equi join on ``(order, line number)`` pairs each line with at most its one
    successor, so the edge list grows linearly with ``lineitem`` however many lines an
    order holds: no pairs within an order are listed, and a hot order is spread over
    the join's hash partitions like any other rows. Repeated edges collapse in a
    partially aggregated ``distinct``."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = li.select(F.col("l_orderkey").alias("_o"), (F.col("l_linenumber") - 1).alias("_ln"),
                    F.col("l_partkey").alias("_p"))
    j = li.join(nxt, (F.col("l_orderkey") == F.col("_o")) & (F.col("l_linenumber") == F.col("_ln")))
    j = j.where(F.col("l_partkey") != F.col("_p"))
    return j.select(F.least("l_partkey", "_p").alias("src"),
                    F.greatest("l_partkey", "_p").alias("dst")).distinct()


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, out_deg, in_deg, degree`` (direction as stored, src -> dst)."""
    out_d = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_deg"))
    in_d = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_deg"))
    z = F.lit(0).cast("bigint")
    j = vertices.select("id").join(out_d, "id", "left").join(in_d, "id", "left")
    o, i = F.coalesce("out_deg", z), F.coalesce("in_deg", z)
    return j.select("id", o.alias("out_deg"), i.alias("in_deg"), (o + i).alias("degree"))


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int = 10,
             damping: float = 0.85, hub_edges: int | None = None) -> DataFrame:
    """PageRank on the undirected graph (both directions), fixed iterations, ranks
    summing to 1. Dangling vertices spread their rank evenly over all vertices.

    With mirrored edges a vertex is dangling exactly when it is isolated, and all
    isolated vertices keep one common rank ``q``: ``q' = (1-d)/n + d*k*q/n`` for ``k``
    isolated of ``n`` vertices. So the dangling mass ``k*q`` is a driver-side scalar
    recurrence from two counts, and a round is one join of the rank vector to the
    bucketed edges plus one partial aggregation by target, with no per-round action.
    Ranks are referenced once per round and written every few rounds."""
    spark = vertices.sparkSession
    cut = cut_edges(edges, "pagerank-edges", hub_edges)
    v = vertices.select("id").join(cut.degree.withColumnRenamed("src", "id"), "id", "left")
    v = materialize(v, "pagerank-vertices")
    n = v.count()
    if n == 0:
        return v.select("id", F.lit(0.0).alias("pr"))
    k = v.where(F.col("deg").isNull()).count()
    rounds = _Rounds(spark, "pagerank-ranks")
    ranks = v.select("id", "deg", F.lit(1.0 / n).alias("pr"))
    q = 1.0 / n
    for i in range(iterations):
        share = ranks.where(F.col("deg").isNotNull()).select(
            F.col("id").alias("src"), (F.col("pr") / F.col("deg")).alias("c"))
        contrib = (cut.edges.join(cut.replicated(share).hint("shuffle_hash"), ["src", "part"])
                    .groupBy(F.col("dst").alias("id")).agg(F.sum("c").alias("in_c")))
        dm = k * q
        ranks = v.join(contrib, "id", "left").select(
            "id", "deg", (F.lit((1 - damping) / n) + F.lit(damping) *
                          (F.coalesce("in_c", F.lit(0.0)) + F.lit(dm / n))).alias("pr"))
        q = (1 - damping) / n + damping * dm / n
        if (i + 1) % SAVE_EVERY == 0 and i + 1 < iterations:
            ranks = rounds.save(ranks)
    return ranks.select("id", "pr")


def _undirected(pairs: DataFrame, dedupe: bool = True) -> DataFrame:
    """``(a, b)`` pairs -> directed ``(src, dst)`` rows in both directions, self loops
    dropped, duplicates removed when ``dedupe``."""
    p = pairs.where(F.col("a") != F.col("b"))
    both = (p.select(F.col("a").alias("src"), F.col("b").alias("dst"))
             .unionByName(p.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return both.distinct() if dedupe else both


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above ``u`` is linked to the smallest of ``u`` and its neighbours."""
    m = e.groupBy("src").agg(F.min("dst").alias("_mn"))
    out = (e.where(F.col("dst") > F.col("src")).join(m, "src")
            .select(F.col("dst").alias("a"), F.least("src", "_mn").alias("b")))
    # duplicates are harmless to the small-star that follows (a minimum, then a
    # deduplicated output), so no shuffle is spent on removing them here
    return _undirected(out, dedupe=False)


def _small_star(e: DataFrame) -> DataFrame:
    """``u`` and its neighbours below it are linked to the smallest of them."""
    lower = e.where(F.col("dst") < F.col("src"))
    m = lower.groupBy("src").agg(F.min("dst").alias("_mn"))
    out = (lower.join(m, "src").select(F.col("dst").alias("a"), F.col("_mn").alias("b"))
                .unionByName(m.select(F.col("src").alias("a"), F.col("_mn").alias("b"))))
    return _undirected(out)


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` = smallest vertex id of the component.

    Alternating large-star and small-star rounds (Kiveris, Lattanzi, Mirrokni,
    Rastogi, Vassilvitskii: "Connected Components in MapReduce and Beyond", 2014; the
    algorithm GraphFrames uses). Each round relinks vertices to smaller local minima
    with one partial aggregation and one join per star; the edge count never grows,
    and the number of rounds grows with the logarithm of the component size, not with
    its diameter (label propagation needs about diameter/2 rounds, unbounded on long
    chains). At the fixed point every component is a star around its smallest vertex.
    Each round is written once into the shared folder; the loop runs until a round leaves
    the edge set unchanged (a count plus a bounded anti-join probe), however many it takes."""
    spark = vertices.sparkSession
    rounds = _Rounds(spark, "components-edges")
    e = rounds.save(_undirected(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    n_e = e.count()
    while True:
        nxt = rounds.save(_small_star(_large_star(e)))
        n_nxt = nxt.count()
        same = n_nxt == n_e and nxt.join(e, ["src", "dst"], "left_anti").limit(1).count() == 0
        e, n_e = nxt, n_nxt
        if same:
            break
    centre = e.groupBy("src").agg(F.min("dst").alias("_mn")).select(
        F.col("src").alias("id"), F.least("src", "_mn").alias("component"))
    return (vertices.select("id").join(centre, "id", "left")
            .select("id", F.coalesce("component", "id").alias("component")))


def _oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge oriented from the lower-degree to the higher-degree end
    (ties by id). Every vertex then has out-degree O(sqrt(edges)), which bounds the
    wedges listed per vertex even around a hub."""
    e = mirrored(edges)
    deg = e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    j = (edges.join(deg.select(F.col("v").alias("src"), F.col("d").alias("ds")), "src")
              .join(deg.select(F.col("v").alias("dst"), F.col("d").alias("dd")), "dst"))
    lo_first = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return j.select(F.when(lo_first, F.col("src")).otherwise(F.col("dst")).alias("u"),
                    F.when(lo_first, F.col("dst")).otherwise(F.col("src")).alias("w"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles, each once: ``(a, b, c)`` with ``a < b < c``.

    The out-neighbours of a vertex in the oriented graph are one array of O(sqrt(edges))
    items. Each oriented edge meets the arrays of its two ends, and their intersection closes
    its triangles: one row per edge between the steps, no list of wedges."""
    o = materialize(_oriented(edges), "oriented")
    out = o.groupBy("u").agg(F.sort_array(F.collect_list("w")).alias("near"))
    ends = (o.join(out.select("u", F.col("near").alias("of_u")), "u")
             .join(out.select(F.col("u").alias("w"), F.col("near").alias("of_w")), "w"))
    closed = ends.select("u", "w", F.explode(F.array_intersect("of_u", "of_w")).alias("z"))
    s = F.sort_array(F.array("u", "w", "z"))
    return closed.select(s[0].alias("a"), s[1].alias("b"), s[2].alias("c"))


def triangle_counts(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, triangles``: triangles through each vertex (0 for none)."""
    t = triangles(edges)
    per = (t.select(F.explode(F.array("a", "b", "c")).alias("id"))
            .groupBy("id").agg(F.count(F.lit(1)).alias("triangles")))
    return (vertices.select("id").join(per, "id", "left")
            .select("id", F.coalesce("triangles", F.lit(0).cast("bigint")).alias("triangles")))


def open_two_hop(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, open_wedges``: motif instances (a)-(b)-(c) with a != c and a, c not
    adjacent, counted per centre b as C(deg(b), 2) - triangles(b). No neighbour pairs
    are listed, so a hub costs nothing extra."""
    d = degrees(vertices, edges).select("id", "degree")
    t = triangle_counts(vertices, edges)
    return d.join(t, "id").select(
        "id", F.expr("degree * (degree - 1) div 2 - triangles").alias("open_wedges"))


def bfs_hops(vertices: DataFrame, edges: DataFrame, landmarks: list[int],
             hub_edges: int | None = None) -> DataFrame:
    """``landmark, id, hops`` for every vertex reachable from each landmark.

    Frontier expansion: neighbours of the frontier (joined to the bucketed edges) not
    yet visited form the next frontier. Each frontier is written once, as folder
    ``hops=<r>`` of one output folder in the shared folder, so the visited set is that
    folder and the result is its read; nothing is rewritten. Runs until a frontier is
    empty, so every reachable vertex is found."""
    spark = vertices.sparkSession
    cut = cut_edges(edges, "bfs-edges", hub_edges)
    out = scratch_path(spark, "bfs-hops")
    schema = "landmark bigint, id bigint, hops int"
    lm = spark.createDataFrame([(int(x),) for x in landmarks], "landmark long")
    (lm.join(vertices.select("id"), F.col("landmark") == F.col("id"))
       .select("landmark", "id").write.parquet(f"{out}/hops=0"))
    for r in itertools.count(1):
        frontier = spark.read.schema("landmark bigint, id bigint").parquet(f"{out}/hops={r - 1}")
        visited = spark.read.schema(schema).parquet(out).select("landmark", "id")
        reach = cut.replicated(frontier.select("landmark", F.col("id").alias("src")))
        nxt = (cut.edges.join(reach.hint("shuffle_hash"), ["src", "part"])
                .select("landmark", F.col("dst").alias("id")).distinct()
                .join(visited, ["landmark", "id"], "left_anti"))
        nxt.write.parquet(f"{out}/hops={r}")
        if spark.read.schema("landmark bigint, id bigint").parquet(f"{out}/hops={r}") \
                .limit(1).count() == 0:
            break
    return spark.read.schema(schema).parquet(out)
