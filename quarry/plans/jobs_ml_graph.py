"""Machine-learning and graph jobs. Graph: vertices = parts, undirected edges = the
parts of two consecutive lines of one order (stored once, src < dst; see
``graph.consecutive_line_edges``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import ml as M
from quarry.operators.itemsets import frequent_itemsets
from quarry.plans.registry import job
from quarry.session import materialize
from quarry.sources.tables import table


@job("ml_feature_scale", sql="""
  SELECT l_orderkey, l_linenumber,
    round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 6) AS z_l_quantity,
    round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_samp(l_extendedprice) OVER (), 6)
      AS z_l_extendedprice,
    round((l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER (), 6) AS z_l_discount
  FROM lineitem
""")
def q_ml_feature_scale(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    z = M.feature_scale(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], cols)
    return z.select("l_orderkey", "l_linenumber", *[F.round("z_" + c, 6).alias("z_" + c) for c in cols])


@job("ml_kmeans", sql="SELECT vec_id, true AS nearest FROM embeddings")
def q_ml_kmeans(spark, sf):
    """Every vector once, and whether its cluster is that of the nearest centre."""
    return M.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", "nearest")


@job("ml_linear_regression", sql="""
  SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
         round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
         round(regr_r2(l_extendedprice, l_quantity), 6) AS r2
  FROM lineitem
""")
def q_ml_linear_regression(spark, sf):
    fit = M.linear_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return fit.select(*[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")])


@job("ml_logistic", sql="""
  SELECT doc_id, l.doc_id IS NOT NULL AS labelled, true AS scored
  FROM documents LEFT JOIN labels l USING (doc_id)
""")
def q_ml_logistic(spark, sf):
    """Every document once: whether it has a label, and whether its prediction is the
    side of 0.5 its probability is on."""
    out = M.logistic_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    side = (F.col("p_good") >= 0.5).cast("double")
    return out.select("doc_id", F.col("label").isNotNull().alias("labelled"),
                      (F.col("p_good").between(0, 1) & (F.col("prediction") == side)).alias("scored"))


_BASKETS = "b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"


@job("ml_frequent_items", sql=f"""
  WITH {_BASKETS}
  SELECT x.l_partkey AS item_a, y.l_partkey AS item_b, count(*) AS freq
  FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey
  GROUP BY 1, 2 HAVING count(*) >= 2
""")
def q_ml_frequent_items(spark, sf):
    """Pairs of parts that occur together in at least two whole orders."""
    found = frequent_itemsets(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey", min_count=2, max_size=2)
    return found.select(F.col("items")[0].alias("item_a"), F.col("items")[1].alias("item_b"), "freq")


@job("ml_frequent_itemsets", sql=f"""
  WITH b AS (SELECT DISTINCT s.s_nationkey AS x, o.o_custkey AS c
             FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN supplier s ON l_suppkey = s_suppkey),
  k AS (SELECT count(DISTINCT c) // 5 AS least FROM b)
  SELECT [x1.x, x2.x] AS items, count(*) AS freq FROM b x1 JOIN b x2 ON x1.c = x2.c AND x1.x < x2.x
  GROUP BY ALL HAVING count(*) >= (SELECT least FROM k)
  UNION ALL
  SELECT [x1.x, x2.x, x3.x], count(*) FROM b x1 JOIN b x2 ON x1.c = x2.c AND x1.x < x2.x JOIN b x3 ON x1.c = x3.c AND x2.x < x3.x
  GROUP BY ALL HAVING count(*) >= (SELECT least FROM k)
""")
def q_ml_frequent_itemsets(spark, sf):
    """Pairs and triples of supplier nations of which a fifth of all ordering customers buy."""
    lines = (table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
             .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("o_custkey", "s_nationkey"))
    least = lines.select("o_custkey").distinct().count() // 5
    return frequent_itemsets(lines, "o_custkey", "s_nationkey", min_count=least, max_size=3)


# ------------------------------------------------------------------------------ graph

_EDGES = """
  e0 AS (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src,
                         greatest(a.l_partkey, b.l_partkey) AS dst
         FROM lineitem a JOIN lineitem b
           ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
         WHERE a.l_partkey <> b.l_partkey),
  e AS (SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0),
  v AS (SELECT p_partkey AS id FROM part)
"""


def _graph(spark, sf):
    """Vertices, and the edge list written once to the shared folder: every graph job
    reads its edges several times (degrees, orientation, closing edges, rounds), and
    the lineitem self-join that builds them is the expensive step at scale."""
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return v, materialize(G.consecutive_line_edges(table(spark, sf, "lineitem")), "graph-edges")


@job("graph_degrees", sql=f"""
  WITH {_EDGES},
  o AS (SELECT src AS id, count(*) AS out_deg FROM e0 GROUP BY 1),
  i AS (SELECT dst AS id, count(*) AS in_deg FROM e0 GROUP BY 1)
  SELECT id, coalesce(out_deg, 0) AS out_deg, coalesce(in_deg, 0) AS in_deg,
         coalesce(out_deg, 0) + coalesce(in_deg, 0) AS degree
  FROM v LEFT JOIN o USING (id) LEFT JOIN i USING (id)
""")
def q_graph_degrees(spark, sf):
    return G.degrees(*_graph(spark, sf))


def _pagerank_sql(iterations=10, damping=0.85):
    parts = [f"""WITH {_EDGES},
  n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v),
  deg AS (SELECT src AS id, count(*) AS deg FROM e GROUP BY 1),
  r0 AS (SELECT v.id, deg.deg, 1.0 / n.n AS pr FROM v LEFT JOIN deg USING (id), n)"""]
    for i in range(1, iterations + 1):
        p = f"r{i - 1}"
        parts.append(f"""  r{i} AS (SELECT r.id, r.deg,
      {1 - damping!r} / n.n + {damping!r} * (coalesce(c.in_c, 0) + d.dm / n.n) AS pr
    FROM {p} r LEFT JOIN (SELECT e.dst AS id, sum(s.pr / s.deg) AS in_c
                          FROM e JOIN {p} s ON e.src = s.id GROUP BY 1) c USING (id),
         (SELECT coalesce(sum(pr), 0) AS dm FROM {p} WHERE deg IS NULL) d, n)""")
    return ",\n".join(parts) + f"\nSELECT id, round(pr * n, 9) AS pr_scaled FROM r{iterations}, n"


@job("graph_pagerank", sql=_pagerank_sql())
def q_graph_pagerank(spark, sf):
    v, e = _graph(spark, sf)
    n = v.count()
    return G.pagerank(v, e).select("id", F.round(F.col("pr") * n, 9).alias("pr_scaled"))


@job("graph_components", sql=f"""
  WITH RECURSIVE {_EDGES},
  reach(id, label) AS (
    SELECT id, id FROM v
    UNION
    SELECT e.dst, r.label FROM reach r JOIN e ON r.id = e.src WHERE r.label < e.dst)
  SELECT id, min(label) AS component FROM reach GROUP BY id
""")
def q_graph_components(spark, sf):
    return G.connected_components(*_graph(spark, sf))


_TRIANGLES = """
  t AS (SELECT e1.src AS a, e1.dst AS b, e2.dst AS c FROM e0 e1
        JOIN e0 e2 ON e1.dst = e2.src JOIN e0 e3 ON e3.src = e1.src AND e3.dst = e2.dst),
  tc AS (SELECT x AS id, count(*) AS triangles FROM (
           SELECT a AS x FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1)
"""


@job("graph_triangles", sql=f"""
  WITH {_EDGES}, {_TRIANGLES}
  SELECT id, coalesce(triangles, 0) AS triangles FROM v LEFT JOIN tc USING (id)
""")
def q_graph_triangles(spark, sf):
    return G.triangle_counts(*_graph(spark, sf))


@job("graph_two_hop", sql=f"""
  WITH {_EDGES}
  SELECT v.id, count(p.a) AS open_wedges FROM v LEFT JOIN (
    SELECT x.src AS b, x.dst AS a, y.dst AS c FROM e x JOIN e y ON x.src = y.src AND x.dst < y.dst
    WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.src = x.dst AND z.dst = y.dst)) p ON p.b = v.id
  GROUP BY v.id
""")
def q_graph_two_hop(spark, sf):
    return G.open_two_hop(*_graph(spark, sf))


@job("graph_shortest_paths", sql=f"""
  WITH RECURSIVE {_EDGES},
  deg AS (SELECT src AS id, count(*) AS d FROM e GROUP BY 1),
  lm AS (SELECT id FROM deg ORDER BY d DESC, id LIMIT 3),
  bfs(landmark, id, hops) USING KEY (landmark, id) AS (
    SELECT id, id, 0 FROM lm
    UNION
    SELECT b.landmark, e.dst, min(b.hops) + 1 FROM bfs b JOIN e ON b.id = e.src
    WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.landmark = b.landmark AND r.id = e.dst)
    GROUP BY 1, 2)
  SELECT landmark, id, CAST(hops AS INTEGER) AS hops FROM bfs
""")
def q_graph_shortest_paths(spark, sf):
    v, e = _graph(spark, sf)
    d = G.degrees(v, e)
    hubs = [r["id"] for r in d.orderBy(F.col("degree").desc(), F.col("id")).limit(3).collect()]
    return G.bfs_hops(v, e, hubs)
