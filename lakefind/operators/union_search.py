"""Tables that can be unioned with a query table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefind.functions.ranking import rank_within
from lakefind.operators.knn import grid_topk, knn, merge_topk
from lakefind.operators.vectors import pool
from lakefind.session import materialize

TABLE_ORDER = ["query_table", "cand_table", "rank", "score"]


def _rank_tables(scores: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.col("cand_table")]
    return rank_within(scores, ["query_table"], order, "rank", limit=k).select(*TABLE_ORDER)


def union_pooled(queries: DataFrame, lake: DataFrame, k: int, method: str = "max") -> DataFrame:
    """Top-``k`` tables by the cosine of pooled vectors; the query itself is kept."""
    return knn(pool(queries, method), pool(lake, method), k).select(*TABLE_ORDER)


def _table_scores(matches: DataFrame, k: int) -> DataFrame:
    scores = matches.groupBy("query_table", "cand_table").agg(
        F.greatest(F.lit(0.0), F.max("score")).alias("score"))
    return _rank_tables(scores, k)


def union_columnwise(queries: DataFrame, lake: DataFrame, k: int) -> DataFrame:
    """Every query column brings its ``2k`` nearest columns; a table scores its best one."""
    return _table_scores(knn(queries, lake, 2 * k), k)


def union_two_step(queries: DataFrame, lake: DataFrame, k: int, filter_k: int = 100, method: str = "max") -> DataFrame:
    """Pooled search for ``filter_k`` tables, then column-wise search inside each query's survivors.

    All queries run in one job: a query meets the columns of its own
    candidates through the key ``query table``.
    """
    survivors = union_pooled(queries, lake, filter_k, method).select("query_table", "cand_table")
    inside = lake.join(survivors, F.col("table_id") == F.col("cand_table")).select(
        F.col("query_table").alias("_key"), "table_id", F.col("col_idx").cast("int").alias("col_idx"), "vec")
    asked = queries.select(F.col("table_id").alias("_key"), "table_id", F.col("col_idx").cast("int").alias("col_idx"),
                           "vec")
    return _table_scores(merge_topk(grid_topk(asked, inside, 2 * k, ["_key"]), 2 * k), k)


def cluster_sets(clusters: DataFrame) -> DataFrame:
    """Distinct column clusters of each table, noise left out."""
    return clusters.filter(F.col("cluster") != -1).select("table_id", "cluster").distinct()


def noise_share(clusters: DataFrame) -> DataFrame:
    """Columns, noise columns and their share."""
    noise = F.col("cluster") == -1
    return clusters.agg(F.count(F.lit(1)).alias("n_columns"), F.count_if(noise).alias("n_noise"),
                        F.avg(noise.cast("double")).alias("noise_share"))


def _classes(clusters: DataFrame) -> DataFrame:
    """``(table_id, class, n)``: tables with equal cluster sets share a class.

    A table has at most as many clusters as columns, so its sorted set fits a row.
    """
    grouped = cluster_sets(clusters).groupBy("table_id").agg(F.sort_array(F.collect_set("cluster")).alias("set"))
    return grouped.select("table_id", "set", F.size("set").cast("long").alias("n"))


def _rare_first(sets: DataFrame) -> DataFrame:
    """Written ``(set, n, at, cluster)``: the clusters of each distinct set, those that few sets hold first (``at`` from 1)."""
    each = sets.select("set", "n").distinct().withColumn("cluster", F.explode("set"))
    often = each.groupBy("cluster").agg(F.count(F.lit(1)).alias("often"))
    order = F.sort_array(F.collect_list(F.struct("often", "cluster")))  # a set's clusters are at most its columns
    placed = each.join(often, "cluster").groupBy("set", "n").agg(order.alias("order"))
    return materialize(placed.select("set", "n", F.posexplode("order").alias("at", "o")).select(
        "set", "n", (F.col("at") + 1).alias("at"), F.col("o.cluster").alias("cluster")))


def _jaccard(pairs: DataFrame) -> DataFrame:
    both = F.size(F.array_intersect("q_set", "c_set"))
    return pairs.withColumn("score", both / (F.size("q_set") + F.size("c_set") - both))


def first_candidates(asked: DataFrame, placed: DataFrame, offers: DataFrame, k: int) -> DataFrame:
    """``(q_set, c_set, cand_table)``: of each cluster of a query the ``k`` tables with the smallest sets, ties by id.

    A table further down the list that shares nothing else with the query scores no more than any of these, and
    comes later if it scores the same: it is never among the best ``k``.
    """
    entries = placed.select("set", "n", "cluster").join(offers, "set")
    heads = rank_within(entries, ["cluster"], [F.col("n"), F.col("table_id")], "_place", limit=k)
    heads = heads.select("cluster", F.col("set").alias("c_set"), F.col("table_id").alias("cand_table"))
    return placed.join(asked, "set", "left_semi").select("cluster", F.col("set").alias("q_set")).join(heads, "cluster").select(
        "q_set", "c_set", "cand_table").distinct()


def prefix_pairs(placed: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(q_set, c_set)`` that share two clusters or more and may score at least the ``bound`` of the query's set.

    With ``need`` shared clusters the first one in a common order is within the first n - need + 1 of both sets.
    As ``need`` is two or more, the most frequent cluster of a set is never looked up.
    """
    q = placed.join(bounds, "set").alias("q")
    c = placed.filter(F.col("at") < F.col("n")).alias("c")
    bound, sizes = F.col("q.bound"), F.col("q.n") + F.col("c.n")
    need = F.greatest(F.lit(2), F.ceil(bound / (1 + bound) * sizes - 1e-9))
    near = F.least("q.n", "c.n") >= bound * F.greatest("q.n", "c.n") - 1e-9
    alone = F.greatest(F.lit(2), F.ceil(bound * F.col("q.n") - 1e-9))
    met = q.filter(F.col("q.at") <= F.col("q.n") - alone + 1).join(
        c, (F.col("q.cluster") == F.col("c.cluster")) & near & (F.col("q.at") <= F.col("q.n") - need + 1)
        & (F.col("c.at") <= F.col("c.n") - need + 1))
    return met.select(F.col("q.set").alias("q_set"), F.col("c.set").alias("c_set")).distinct()


def _best_sets(asked: DataFrame, sets: DataFrame, offers: DataFrame, k: int) -> DataFrame:
    """``(q_set, c_set, score)``: every pair of sets that can offer one of the best ``k`` tables of a query.

    The heads of the lists give each query a bound, the score of its k-th table so far; only sets that
    may reach it are joined through rare prefixes and compared.
    """
    placed = _rare_first(sets)
    near = materialize(_jaccard(first_candidates(asked, placed, offers, k)))
    kth = rank_within(near, ["q_set"], [F.desc("score"), F.col("cand_table")], "_place", limit=k).filter(F.col("_place") == k)
    bounds = asked.join(kth.select(F.col("q_set").alias("set"), F.col("score").alias("bound")), "set", "left").select(
        "set", F.coalesce("bound", F.lit(0.0)).alias("bound"))
    heads = near.select("q_set", "c_set", "score").distinct()
    far = prefix_pairs(placed, bounds).join(heads, ["q_set", "c_set"], "left_anti")
    return heads.unionByName(_jaccard(far))


def cluster_jaccard(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Jaccard of the cluster sets of the given ``(query_table, cand_table)`` pairs; 0 if either is empty."""
    sets = _classes(clusters)
    both = (
        pairs.join(sets.select(F.col("table_id").alias("query_table"), F.col("set").alias("q_set")), "query_table", "left")
        .join(sets.select(F.col("table_id").alias("cand_table"), F.col("set").alias("c_set")), "cand_table", "left")
    )
    score = F.size(F.array_intersect("q_set", "c_set")) / F.size(F.array_union("q_set", "c_set"))
    known = F.col("q_set").isNotNull() & F.col("c_set").isNotNull()
    return both.select("query_table", "cand_table", F.when(known, score).otherwise(0.0).alias("score"))


def union_by_cluster(queries: DataFrame, clusters: DataFrame, k: int = 10, fill: bool = True) -> DataFrame:
    """Top-``k`` tables by cluster-set Jaccard, ties by table id.

    Scores depend on the cluster set alone, so they are computed once per pair
    of distinct sets, and a set offers only its ``k`` smallest table ids: no
    more can reach a top-k.  Pairs come from the heads of the clusters' lists and from rare
    prefixes, so a cluster that every table has makes no pairs of all tables.  With ``fill`` zero-score tables complete a short
    list; the ``k`` smallest table ids of the lake are enough for that.
    """
    sets = _classes(clusters)
    asked = queries.select("table_id").distinct()
    q = asked.join(sets, "table_id")
    offers = rank_within(sets, ["set"], [F.col("table_id")], "_at", limit=k)
    offers = offers.select("set", "table_id")
    top_sets = _best_sets(q.select("set").distinct(), sets, offers, k).join(
        offers.select(F.col("set").alias("c_set"), F.col("table_id").alias("cand_table")), "c_set")
    ranked = rank_within(top_sets, ["q_set"], [F.desc("score"), F.col("cand_table")], "rank", limit=k)
    scored = q.join(ranked, F.col("set") == F.col("q_set")).select(
        F.col("table_id").alias("query_table"), "cand_table", "score")
    if not fill:
        return _rank_tables(scored, k)
    first_ids = [row[0] for row in clusters.select("table_id").distinct().orderBy("table_id").limit(k).collect()]
    zeros = asked.select(F.col("table_id").alias("query_table"),
                         F.explode(F.array(*[F.lit(t) for t in first_ids])).alias("cand_table"))
    zeros = zeros.join(scored, ["query_table", "cand_table"], "left_anti").withColumn("score", F.lit(0.0))
    return _rank_tables(scored.unionByName(zeros), k)
