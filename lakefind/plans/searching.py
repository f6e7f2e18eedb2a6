"""Vector shaping, joinable-column search, union search and exact overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefind.functions.vectors import cosine, l2_normalize
from lakefind.operators import knn as K
from lakefind.operators import overlap as O
from lakefind.operators import sketch as S
from lakefind.operators import union_search as U
from lakefind.operators import vectors as V
from lakefind.plans.registry import query
from lakefind.plans.views import cells, clusters, col_vectors, read, with_views
from lakefind.session import materialize

# --- vectors ---------------------------------------------------------------------------------


def matrices(spark, sf):
    """Vectors regrouped to one matrix per table, as an embedding job hands them over."""
    rows = col_vectors(spark, sf)
    return rows.groupBy("table_id").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", "vec"))).alias("parts")).select(
        "table_id", F.transform("parts", lambda p: p["vec"]).alias("matrix"))


ORDINALS = ("ordinals", "SELECT table_id, row_number() OVER (ORDER BY table_id) AS rn FROM "
                        "(SELECT DISTINCT table_id FROM col_vectors)")


@query("flatten_vectors", with_views(["vectors"], ORDINALS, select=(
    "SELECT rn - 1 AS index, table_id, CAST(col_idx AS BIGINT) AS col_idx, col_name, round(vec[1], 6) AS x0, "
    "round(list_sum(vec), 4) AS x_sum FROM col_vectors JOIN ordinals USING (table_id)")))
def _(spark, sf):
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return V.flatten(matrices(spark, sf)).select(
        "index", "table_id", F.col("col_idx").cast("long"), "col_name",
        F.round(F.col("vec")[0].cast("double"), 6).alias("x0"), F.round(total, 4).alias("x_sum"))


@query("vector_offsets", with_views(["vectors"], ORDINALS, select=(
    "SELECT table_id, rn - 1 AS index, length FROM (SELECT table_id, count(*) AS length FROM col_vectors GROUP BY 1) "
    "JOIN ordinals USING (table_id)")))
def _(spark, sf):
    return V.offsets(col_vectors(spark, sf))


def _with_nan(spark, sf):
    """Label 9 vectors get a NaN component."""
    return read(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("label") == 9, F.array_insert("embedding", 3, F.lit(float("nan")).cast("float")))
        .otherwise(F.col("embedding")).alias("vec"))


@query("drop_nan_vectors", "SELECT vec_id FROM embeddings WHERE label <> 9")
def _(spark, sf):
    return V.drop_nan(_with_nan(spark, sf)).select("vec_id")


@query("count_nan_vectors",
       "SELECT count(*) FILTER (label <> 9) AS n_valid, count(*) FILTER (label = 9) AS n_nan FROM embeddings")
def _(spark, sf):
    return V.nan_counts(_with_nan(spark, sf))


@query("l2_normalize_vectors", """
SELECT vec_id, i - 1 AS dim, round(e[i] * (1 + label) / sqrt(list_sum(list_transform(e, lambda x: x * x))) / (1 + label), 6)
  AS x FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")
def _(spark, sf):
    # Scaled by the label first, so that the vectors are not unit length already.
    scaled = read(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("vec"))
    return scaled.select("vec_id", F.posexplode(l2_normalize("vec")).alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("long"), F.round("x", 6).alias("x"))


for _method, _sql in (("mean", "avg"), ("sum", "sum"), ("max", "max")):
    @query(f"pool_vectors_{_method}", with_views(["vectors"], select=(
        f"SELECT table_id, i - 1 AS dim, round({_sql}(vec[i]), 6) AS x FROM (SELECT table_id, vec, "
        "unnest(range(1, len(vec) + 1)) AS i FROM col_vectors) GROUP BY 1, 2")))
    def _(spark, sf, method=_method):
        return V.pool_components(col_vectors(spark, sf), method).select(
            "table_id", F.col("dim").cast("long"), F.round("x", 6).alias("x"))


# --- nearest columns -------------------------------------------------------------------------

SCORED = [
    ("normed", "SELECT *, sqrt(list_dot_product(vec, vec)) AS n FROM col_vectors"),
    ("scored", "SELECT q.table_id AS query_table, q.col_idx AS query_col, c.table_id AS cand_table, "
               "c.col_idx AS cand_col, round(list_dot_product(q.vec, c.vec) / (q.n * c.n), 10) AS score "
               "FROM normed q, normed c"),
]
RANKED = "row_number() OVER (PARTITION BY query_table, query_col ORDER BY score DESC, cand_table, cand_col) AS rank"
PAIR_OUT = ("query_table, CAST(query_col AS BIGINT) AS query_col, cand_table, CAST(cand_col AS BIGINT) AS cand_col, "
            "rank, round(score, 6) AS score")


def pair_out(df, *more):
    return df.select(*more, "query_table", F.col("query_col").cast("long"), "cand_table",
                     F.col("cand_col").cast("long"), "rank", F.round("score", 6).alias("score"))


def _knn_sql(k: int, where: str = "true") -> str:
    return with_views(["vectors"], *SCORED, ("ranked", f"SELECT *, {RANKED} FROM scored WHERE {where}"),
                      select=f"SELECT {PAIR_OUT} FROM ranked WHERE rank <= {k}")


@query("knn_exact", _knn_sql(20))
def _(spark, sf):
    v = col_vectors(spark, sf)
    return pair_out(K.knn(v, v, 20))


@query("joinable_columns", _knn_sql(10))
def _(spark, sf):
    v = col_vectors(spark, sf)
    first = v.withColumn("at", F.lit(1))
    later = v.withColumns({"vec": F.reverse("vec"), "at": F.lit(2)})  # a repeated query with another vector
    return pair_out(K.joinable(first.unionByName(later), v, 10, position="at"))


@query("joinable_columns_other_tables", _knn_sql(10, "query_table <> cand_table"))
def _(spark, sf):
    v = col_vectors(spark, sf)
    return pair_out(K.joinable(v, v, 10, exclude_same_table=True))


@query("knn_lsh")
def _(spark, sf):
    v = col_vectors(spark, sf)
    return pair_out(K.knn(v, v, 10, method="lsh"))


@query("knn_ivf")
def _(spark, sf):
    v = col_vectors(spark, sf)
    return pair_out(K.knn(v, v, 10, method="ivf", n_lists=32, n_probe=8))


@query("knn_ivfpq")
def _(spark, sf):
    v = col_vectors(spark, sf)
    return pair_out(K.knn(v, v, 10, method="ivfpq", n_lists=32, n_probe=8, n_codes=32))


def sharded(spark, sf):
    return col_vectors(spark, sf).withColumn("shard", F.expr("col_idx % 6 + 1"))


def overlapping(spark, sf):
    """Shards of which the second also holds the first column of every table, with its vector reversed."""
    v = sharded(spark, sf)
    again = v.filter("col_idx = 0").withColumns({"vec": F.reverse("vec"), "shard": F.lit(2)})
    return v.unionByName(again)


@query("knn_by_shard", with_views(
    ["vectors"],
    ("held", "SELECT table_id, col_idx, vec, col_idx % 6 + 1 AS shard FROM col_vectors UNION ALL "
             "SELECT table_id, col_idx, list_reverse(vec), 2 FROM col_vectors WHERE col_idx = 0"),
    ("scored", "SELECT q.table_id AS query_table, q.col_idx AS query_col, c.table_id AS cand_table, c.col_idx AS cand_col, shard, "
               "round(list_dot_product(q.vec, c.vec) / sqrt(list_dot_product(q.vec, q.vec) * list_dot_product(c.vec, c.vec)), 10) "
               "AS score FROM col_vectors q, held c"),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY shard, query_table, query_col "
               "ORDER BY score DESC, cand_table, cand_col) AS rank FROM scored"),
    select=f"SELECT CAST(shard AS BIGINT) AS shard, {PAIR_OUT} FROM ranked WHERE rank <= 10"))
def _(spark, sf):
    return pair_out(K.knn_by_shard(col_vectors(spark, sf), overlapping(spark, sf), 10), F.col("shard").cast("long"))


@query("knn_merged_shards", _knn_sql(10))
def _(spark, sf):
    v = sharded(spark, sf)
    parts = K.knn_by_shard(v, v, 10).drop("rank", "shard")
    return pair_out(K.merge_topk(parts, 10))


@query("cosine_distance_of_matches", with_views(
    ["vectors"], *SCORED, ("ranked", f"SELECT *, {RANKED} FROM scored WHERE query_table <> cand_table"),
    select=f"SELECT {PAIR_OUT.replace('round(score, 6) AS score', 'round(1 - score, 6) AS distance')} FROM ranked "
           "WHERE rank <= 10"))
def _(spark, sf):
    v = col_vectors(spark, sf)
    found = K.knn(v, v, 10, exclude_same_table=True).drop("score")
    q = v.select(F.col("table_id").alias("query_table"), F.col("col_idx").alias("query_col"), F.col("vec").alias("qv"))
    c = v.select(F.col("table_id").alias("cand_table"), F.col("col_idx").alias("cand_col"), F.col("vec").alias("cv"))
    pairs = found.join(q, ["query_table", "query_col"]).join(c, ["cand_table", "cand_col"])
    return pairs.select("query_table", F.col("query_col").cast("long"), "cand_table", F.col("cand_col").cast("long"),
                        "rank", F.round(1 - cosine("qv", "cv"), 6).alias("distance"))


# --- union search ----------------------------------------------------------------------------

TABLE_OUT = "query_table, cand_table, rank, round(score, 6) AS score"
TABLE_RANK = "row_number() OVER (PARTITION BY query_table ORDER BY score DESC, cand_table) AS rank"


def table_out(df):
    return df.select("query_table", "cand_table", "rank", F.round("score", 6).alias("score"))


def pooled(method: str = "max") -> list[tuple[str, str]]:
    agg = {"max": "max", "mean": "avg", "sum": "sum"}[method]
    return [
        ("parts", f"SELECT table_id, i, {agg}(vec[i]) AS x FROM (SELECT table_id, vec, unnest(range(1, len(vec) + 1)) "
                  "AS i FROM col_vectors) GROUP BY 1, 2"),
        ("pooled", "SELECT table_id, vec, sqrt(list_dot_product(vec, vec)) AS n FROM (SELECT table_id, "
                   "list(x ORDER BY i) AS vec FROM parts GROUP BY 1)"),
        ("table_scored", "SELECT q.table_id AS query_table, c.table_id AS cand_table, "
                         "round(list_dot_product(q.vec, c.vec) / (q.n * c.n), 10) AS score FROM pooled q, pooled c"),
        ("table_ranked", f"SELECT *, {TABLE_RANK} FROM table_scored"),
    ]


@query("union_pooled", with_views(["vectors"], *pooled(), select=f"SELECT {TABLE_OUT} FROM table_ranked WHERE rank <= 10"))
def _(spark, sf):
    v = col_vectors(spark, sf)
    return table_out(U.union_pooled(v, v, 10))


def columnwise(source: str, k: int) -> list[tuple[str, str]]:
    return [
        ("col_ranked", f"SELECT *, {RANKED} FROM {source}"),
        ("best", "SELECT query_table, cand_table, greatest(0, max(score)) AS score FROM col_ranked "
                 f"WHERE rank <= {2 * k} GROUP BY 1, 2"),
        ("final", f"SELECT *, {TABLE_RANK} FROM best"),
    ]


@query("union_columnwise", with_views(["vectors"], *SCORED, *columnwise("scored", 10),
                                      select=f"SELECT {TABLE_OUT} FROM final WHERE rank <= 10"))
def _(spark, sf):
    v = col_vectors(spark, sf)
    return table_out(U.union_columnwise(v, v, 10))


@query("union_two_step", with_views(
    ["vectors"], *SCORED, *pooled(),
    ("inside", "SELECT s.* FROM scored s JOIN table_ranked t ON s.query_table = t.query_table AND "
               "s.cand_table = t.cand_table WHERE t.rank <= 25"),
    *columnwise("inside", 10), select=f"SELECT {TABLE_OUT} FROM final WHERE rank <= 10"))
def _(spark, sf):
    v = col_vectors(spark, sf)
    return table_out(U.union_two_step(v, v, 10, filter_k=25))


SETS = ("sets", "SELECT DISTINCT table_id, cluster FROM clusters WHERE cluster <> -1")


@query("cluster_sets", with_views(["clusters"], SETS, select="SELECT table_id, CAST(cluster AS BIGINT) AS cluster FROM sets"))
def _(spark, sf):
    return U.cluster_sets(clusters(spark, sf)).select("table_id", F.col("cluster").cast("long"))


JACCARD = [
    SETS,
    ("sizes", "SELECT table_id, count(*) AS n FROM sets GROUP BY 1"),
    ("both_", "SELECT a.table_id AS query_table, b.table_id AS cand_table, count(*) AS b FROM sets a JOIN sets b "
              "USING (cluster) GROUP BY 1, 2"),
    ("tables_", "SELECT DISTINCT table_id FROM clusters"),
    ("jaccard", "SELECT q.table_id AS query_table, c.table_id AS cand_table, coalesce(b / (x.n + y.n - b), 0.0) AS score "
                "FROM tables_ q CROSS JOIN tables_ c LEFT JOIN both_ ON query_table = q.table_id AND cand_table = "
                "c.table_id LEFT JOIN sizes x ON x.table_id = q.table_id LEFT JOIN sizes y ON y.table_id = c.table_id"),
]


@query("cluster_jaccard", with_views(
    ["vectors", "clusters"], *pooled(), *JACCARD,
    select="SELECT query_table, cand_table, round(j.score, 6) AS score FROM jaccard j JOIN table_ranked t "
           "USING (query_table, cand_table) WHERE rank <= 10"))
def _(spark, sf):
    v = col_vectors(spark, sf)
    pairs = U.union_pooled(v, v, 10).select("query_table", "cand_table")
    return U.cluster_jaccard(clusters(spark, sf), pairs).select(
        "query_table", "cand_table", F.round("score", 6).alias("score"))


@query("union_by_cluster", with_views(["clusters"], *JACCARD, ("ranked", f"SELECT *, {TABLE_RANK} FROM jaccard"),
                                      select=f"SELECT {TABLE_OUT} FROM ranked WHERE rank <= 10"))
def _(spark, sf):
    c = clusters(spark, sf)
    return table_out(U.union_by_cluster(c.select("table_id"), c, 10))


@query("cluster_noise_share", with_views(["clusters"], select=(
    "SELECT count(*) AS n_columns, count(*) FILTER (cluster = -1) AS n_noise, "
    "round(avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_share FROM clusters")))
def _(spark, sf):
    return U.noise_share(clusters(spark, sf)).withColumn("noise_share", F.round("noise_share", 6))


# --- exact overlap ---------------------------------------------------------------------------

VALUES = ("vals", "SELECT DISTINCT table_id, col_idx, value FROM cells WHERE value IS NOT NULL")
NUM_PERM = 128
MINHASH = [
    VALUES,
    ("perms", "SELECT i, ('0x' || substr(md5('a' || i), 1, 7))::BIGINT + 1 AS a, ('0x' || substr(md5('b' || i), 1, 15))::BIGINT "
              f"AS b FROM (SELECT unnest(range(0, {NUM_PERM})) AS i)"),
    ("hashed", "SELECT table_id, col_idx, ('0x' || substr(md5(value), 1, 15))::BIGINT AS h FROM vals"),
    ("sigs!", "SELECT table_id, col_idx, i, min(CAST((a::HUGEINT * h + b) % 2305843009213693951 AS BIGINT)) AS low FROM hashed, "
             "perms GROUP BY 1, 2, 3"),
]
# Columns of different tables: near sizes by bands tuned to the pair of size parts, far sizes by their shared values.
CONTAINED = 0.5
_LOW, _RECALL = S.least_gap(CONTAINED), S.INDEX_RECALL
PAIRS = [
    ("sizes", "SELECT table_id, col_idx, count(*) AS n FROM vals GROUP BY 1, 2"),
    ("parts", "SELECT *, length(bin(n * n)) - 1 AS part FROM sizes"),
    ("index_shapes", f"SELECT gap, r, b FROM (SELECT gap, r, b, row_number() OVER (PARTITION BY gap ORDER BY r DESC, b) AS rn FROM "
                     f"(SELECT unnest(range({_LOW}, 60)) AS gap), (SELECT r, unnest(range(1, {NUM_PERM} // r + 1)) AS b FROM "
                     f"(SELECT unnest(range({S.MIN_BAND_ROWS}, {S.MAX_BAND_ROWS + 1})) AS r)) WHERE "
                     f"1 - (1 - ({CONTAINED}::DOUBLE / (1 + 2 ** ((gap + 1) / 2.0::DOUBLE) - {CONTAINED})) ** r) ** b >= {_RECALL}) WHERE rn = 1"),
    ("sketch_bands", "SELECT table_id, col_idx, r, i // r AS band, string_agg(low, ',' ORDER BY i) AS key FROM sigs, "
                     "(SELECT DISTINCT r FROM index_shapes) GROUP BY 1, 2, 3, 4"),
    ("near_pairs", "SELECT DISTINCT x.table_id AS query_table, x.col_idx AS query_col, y.table_id AS cand_table, y.col_idx AS cand_col "
                   "FROM parts x JOIN parts y ON x.table_id <> y.table_id JOIN index_shapes s ON s.gap = y.part - x.part "
                   "JOIN sketch_bands q ON q.table_id = x.table_id AND q.col_idx = x.col_idx AND q.r = s.r AND q.band < s.b "
                   "JOIN sketch_bands c ON c.table_id = y.table_id AND c.col_idx = y.col_idx AND c.r = s.r AND c.band = q.band "
                   "AND c.key = q.key"),
    ("far_pairs", "SELECT x.table_id AS query_table, x.col_idx AS query_col, y.table_id AS cand_table, y.col_idx AS cand_col "
                  "FROM (SELECT a.table_id AS qt, a.col_idx AS qc, b.table_id AS ct, b.col_idx AS cc, count(*) AS shared FROM vals a "
                  "JOIN vals b ON a.value = b.value AND a.table_id <> b.table_id GROUP BY 1, 2, 3, 4) JOIN parts x ON x.table_id = qt "
                  "AND x.col_idx = qc JOIN parts y ON y.table_id = ct AND y.col_idx = cc WHERE y.part - x.part > "
                  f"(SELECT max(gap) FROM index_shapes) AND shared / x.n >= {CONTAINED}"),
    ("pairs!", "SELECT * FROM near_pairs UNION ALL SELECT * FROM far_pairs"),
]
OVERLAP = [
    *MINHASH,
    *PAIRS,
    ("shared", "SELECT query_table, query_col, cand_table, cand_col, count(*) AS join_size FROM pairs p JOIN vals a ON "
               "a.table_id = query_table AND a.col_idx = query_col JOIN vals b ON b.table_id = cand_table AND "
               "b.col_idx = cand_col AND a.value = b.value GROUP BY 1, 2, 3, 4"),
    ("measured", "SELECT p.*, a.n AS size_1, b.n AS size_2, coalesce(join_size, 0) AS join_size, "
                 "coalesce(join_size, 0) / a.n AS c, least(a.n, b.n) / greatest(a.n, b.n) AS k FROM pairs p LEFT JOIN "
                 "shared USING (query_table, query_col, cand_table, cand_col) JOIN sizes a ON a.table_id = query_table "
                 "AND a.col_idx = query_col JOIN sizes b ON b.table_id = cand_table AND b.col_idx = cand_col"),
]
OVERLAP_IDS = "query_table, CAST(query_col AS BIGINT) AS query_col, cand_table, CAST(cand_col AS BIGINT) AS cand_col"


def sigs(spark, sf):
    return S.minhash(O.value_sets(cells(spark, sf)), NUM_PERM)


def signed_pairs(spark, sf):
    """Signatures of the whole lake and the column pairs that the containment index finds with them, both written."""
    sets = materialize(O.value_sets(cells(spark, sf)))
    signatures = materialize(S.minhash(sets, NUM_PERM))
    return signatures, materialize(S.candidate_pairs(sets, signatures, CONTAINED))


def found_pairs(spark, sf):
    """Column pairs that the containment index finds in the whole lake."""
    return signed_pairs(spark, sf)[1]


def _ids(df, *more):
    return df.select("query_table", F.col("query_col").cast("long"), "cand_table", F.col("cand_col").cast("long"), *more)


@query("column_value_sets", with_views(["cells"], VALUES, select=(
    "SELECT table_id, CAST(col_idx AS BIGINT) AS col_idx, value FROM vals")))
def _(spark, sf):
    return O.value_sets(cells(spark, sf)).select("table_id", F.col("col_idx").cast("long"), "value")


@query("join_profile", with_views(["cells"], *OVERLAP, select=f"""
SELECT {OVERLAP_IDS}, size_1, size_2, join_size, round(c, 6) AS containment, CAST(CASE
  WHEN c >= 0.75 AND k >= 0.25 THEN 4 WHEN c >= 0.5 AND k >= 0.125 THEN 3 WHEN c >= 0.25 AND k >= 1/12 THEN 2
  WHEN c >= 0.1 THEN 1 ELSE 0 END AS BIGINT) AS quality FROM measured"""))
def _(spark, sf):
    profile = O.join_profile(O.value_sets(cells(spark, sf)), found_pairs(spark, sf))
    return _ids(profile, "size_1", "size_2", "join_size", F.round("containment", 6).alias("containment"),
                F.col("quality").cast("long"))


@query("exact_containment", with_views(["cells"], *OVERLAP, select=f"""
SELECT {OVERLAP_IDS}, round(c, 6) AS containment FROM measured"""))
def _(spark, sf):
    contained = O.containment(O.value_sets(cells(spark, sf)), found_pairs(spark, sf))
    return _ids(contained, F.round("containment", 6).alias("containment"))
