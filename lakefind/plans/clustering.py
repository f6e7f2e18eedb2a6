"""Clustering of the embeddings, its stages and its summaries.

The SQL twins of the merge tree and the spanning tree are the sequential
algorithms as keyed recursion.  Density labels have none; the tests compare
them with a direct version on small fixtures.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefind.operators import cluster as C
from lakefind.operators import vectors as V
from lakefind.operators.knn import knn
from lakefind.plans.registry import query
from lakefind.plans.searching import SCORED
from lakefind.plans.views import clusters, col_vectors, read, with_views

THRESHOLDS = [0.8, 0.6, 0.4, 0.2, 0.195, 0.19, 0.18, 0.1]


def pts(spark, sf):
    return C.points(col_vectors(spark, sf))


DISTANCES = [
    *SCORED,
    ("dist", "SELECT query_table || '#' || query_col AS id, cand_table || '#' || cand_col AS other, query_table, query_col, "
             "cand_table, cand_col, greatest(1 - score, 0) AS d FROM scored"),
    ("dist_ranked", "SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM dist WHERE id <> other"),
    ("cores", "SELECT id, max(d) AS core FROM dist_ranked WHERE rn <= 5 GROUP BY 1"),
]


@query("core_distances", with_views(["vectors"], *DISTANCES, select="SELECT id, round(core, 6) AS core FROM cores"))
def _(spark, sf):
    return C.core_distances(pts(spark, sf), 5).select("id", F.round("core", 6).alias("core"))


@query("mutual_reachability", with_views(
    ["vectors"], *DISTANCES,
    ("near", "SELECT *, row_number() OVER (PARTITION BY query_table, query_col ORDER BY d, cand_table, cand_col) AS rank "
             "FROM dist"),
    select="SELECT n.id, other, round(greatest(a.core, b.core, d), 6) AS w FROM near n JOIN cores a ON a.id = n.id "
           "JOIN cores b ON b.id = other WHERE rank <= 10"))
def _(spark, sf):
    v = col_vectors(spark, sf)
    cores = C.core_distances(pts(spark, sf), 5).select("id", "core")
    near = knn(v, v, 10).select(
        C.point_id("query_table", "query_col").alias("id"), C.point_id("cand_table", "cand_col").alias("other"),
        F.greatest(1 - F.col("score"), F.lit(0.0)).alias("d"))
    far = cores.select(F.col("id").alias("other"), F.col("core").alias("core_b"))
    w = C.mutual_reachability(F.col("core"), F.col("core_b"), F.col("d"))
    return near.join(cores, "id").join(far, "other").select("id", "other", F.round(w, 6).alias("w"))


# Prim's algorithm, one point per step; with ties broken by (u, v) the tree is unique.
PRIM = [
    ("reach", "SELECT d.id, other, round(greatest(a.core, b.core, d), 10) AS w, least(d.id, other) AS u, "
              "greatest(d.id, other) AS v FROM dist d JOIN cores a ON a.id = d.id JOIN cores b ON b.id = other WHERE d.id <> other"),
    ("prim(node, w, u, v, done) USING KEY (node)", """
SELECT other, w, u, v, false FROM reach WHERE id = (SELECT min(id) FROM cores)
UNION (
  WITH chosen AS (SELECT node, w, u, v FROM recurring.prim WHERE NOT done ORDER BY w, u, v LIMIT 1)
  SELECT node, w, u, v, true FROM chosen
  UNION ALL
  SELECT p.node, e.w, e.u, e.v, false FROM recurring.prim p, chosen c, reach e
  WHERE NOT p.done AND p.node <> c.node AND e.id = c.node AND e.other = p.node
    AND (e.w < p.w OR (e.w = p.w AND (e.u < p.u OR (e.u = p.u AND e.v < p.v)))))"""),
]


@query("spanning_tree", with_views(["vectors"], *DISTANCES, *PRIM, select=(
    "SELECT u, v, round(w, 6) AS w FROM prim")).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    picks, _ = C.spanning_rounds(C.core_distances(pts(spark, sf), 5))
    return C.spanning_edges(picks).select("u", "v", F.round("w", 6).alias("w"))


@query("density_clusters")
def _(spark, sf):
    return C.cluster_density(pts(spark, sf), 5, 5)


# Average linkage, one merge per step on the table of cluster pairs: the closest pair (a, b) closes, its
# distances to every other cluster are averaged by size into a, and those of b end.
LINKAGE = [
    ("points!", "SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT table_id || '#' || col_idx AS id FROM col_vectors)"),
    *SCORED,
    ("linkage(a, b, d, na, nb, alive, merged) USING KEY (a, b)", """
SELECT p.n, q.n, 1 - score, 1, 1, true, false FROM scored JOIN points p ON p.id = query_table || '#' || query_col
  JOIN points q ON q.id = cand_table || '#' || cand_col WHERE p.n < q.n
UNION (
  WITH m AS (SELECT a, b, d, na, nb FROM recurring.linkage WHERE alive ORDER BY d, a, b LIMIT 1),
  of_a AS (SELECT CASE WHEN l.a = m.a THEN l.b ELSE l.a END AS x, l.d, CASE WHEN l.a = m.a THEN l.nb ELSE l.na END AS nx
    FROM recurring.linkage l, m WHERE l.alive AND (l.a = m.a OR l.b = m.a) AND NOT (l.a = m.a AND l.b = m.b)),
  of_b AS (SELECT l.a, l.b, CASE WHEN l.a = m.b THEN l.b ELSE l.a END AS x, l.d, l.na, l.nb
    FROM recurring.linkage l, m WHERE l.alive AND (l.a = m.b OR l.b = m.b) AND NOT (l.a = m.a AND l.b = m.b))
  SELECT a, b, d, na, nb, false, true FROM m
  UNION ALL
  SELECT a, b, d, na, nb, false, false FROM of_b
  UNION ALL
  SELECT least(m.a, of_a.x), greatest(m.a, of_a.x), (m.na * of_a.d + m.nb * of_b.d) / (m.na + m.nb),
    CASE WHEN m.a < of_a.x THEN m.na + m.nb ELSE nx END, CASE WHEN m.a < of_a.x THEN nx ELSE m.na + m.nb END, true, false
  FROM m, of_a, of_b WHERE of_a.x = of_b.x)"""),
    ("tree!", "SELECT p.id AS a, q.id AS b, d AS height, na + nb AS size FROM linkage JOIN points p ON p.n = a "
              "JOIN points q ON q.n = b WHERE merged"),
]


def _linkage_sql(*ctes: tuple[str, str], select: str) -> str:
    return with_views(["vectors"], *LINKAGE, *ctes, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


@query("average_linkage_tree", _linkage_sql(select="SELECT a, b, round(height, 6) AS height, CAST(size AS BIGINT) AS size FROM tree"))
def _(spark, sf):
    return C.merge_tree(pts(spark, sf)).select("a", "b", F.round("height", 6).alias("height"), "size")


@query("average_linkage_clusters", _linkage_sql(
    ("cut", "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY height, size, a, b) AS rn FROM tree) "
            "WHERE rn <= (SELECT count(*) FROM points) - 50"),
    ("up(id, root)", "SELECT id, id FROM points UNION ALL SELECT up.id, cut.a FROM up JOIN cut ON cut.b = up.root"),
    ("roots", "SELECT id, min(root) AS root FROM up GROUP BY 1"),
    select="SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM roots"))
def _(spark, sf):
    return C.cluster_average(pts(spark, sf), 50).withColumn("cluster", F.col("cluster").cast("long"))


@query("bisecting_clusters")
def _(spark, sf):
    return C.cluster_average(pts(spark, sf), 16, method="bisecting")


THRESHOLD_ROWS = ("cuts", "SELECT unnest([" + ", ".join(f"{t}::DOUBLE" for t in THRESHOLDS) + "]) AS threshold")


@query("threshold_sweep", _linkage_sql(THRESHOLD_ROWS, select=(
    "SELECT threshold, (SELECT count(*) FROM points) - count(height) AS n_cluster FROM cuts LEFT JOIN tree ON height <= threshold "
    "GROUP BY 1")))
def _(spark, sf):
    points = pts(spark, sf)
    return C.threshold_sweep(C.merge_tree(points), points.count(), THRESHOLDS)


@query("threshold_labels", _linkage_sql(
    THRESHOLD_ROWS,
    ("up(threshold, id, root)", "SELECT threshold, id, id FROM cuts, points UNION ALL SELECT threshold, up.id, tree.a FROM up "
                                "JOIN tree ON tree.b = up.root AND height <= threshold"),
    select="SELECT threshold, id, min(root) AS root FROM up GROUP BY 1, 2"))
def _(spark, sf):
    points = pts(spark, sf)
    return C.threshold_labels(points, C.merge_tree(points), THRESHOLDS)


@query("scatter_cluster_labels", """
SELECT 't' || (vec_id // 5) || '#' || (vec_id % 5) AS id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster FROM embeddings""")
def _(spark, sf):
    labels = clusters(spark, sf).filter(F.col("cluster") != C.NOISE).select(C.point_id().alias("id"), "cluster")
    everyone = col_vectors(spark, sf).select(C.point_id().alias("id"))
    return C.scatter_labels(everyone, labels)


@query("cluster_summary", """
SELECT count(DISTINCT label) FILTER (label NOT IN (8, 9)) AS n_clusters, count(*) FILTER (label IN (8, 9)) AS n_noise_points,
  count(*) FILTER (label = 8) AS n_nan_rows FROM embeddings""")
def _(spark, sf):
    """Vectors of label 8 hold a NaN: they have no cluster and count as noise."""
    nan = F.array_insert("embedding", 3, F.lit(float("nan")).cast("float"))
    rows = read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.expr(f"CASE WHEN label = 9 THEN {C.NOISE} ELSE label END").alias("cluster"),
        F.when(F.col("label") == 8, nan).otherwise(F.col("embedding")).alias("vec"))
    labels = C.scatter_labels(rows.select("id"), V.drop_nan(rows))
    return C.cluster_summary(labels, V.nan_counts(rows).first().n_nan)
