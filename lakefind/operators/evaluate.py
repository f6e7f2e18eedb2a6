"""Retrieval quality of ranked candidate lists against a ground truth.

``candidates(method?, query, cand, rank)`` and ``truth(query, cand)`` are flat;
``query`` and ``cand`` may be any column (a table, or a struct of table and
column).  Queries without a ground truth are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ["p", "r", "rp", "f1", "ap"]


def hits_at_k(candidates: DataFrame, truth: DataFrame, k: int, by: tuple[str, ...] = (),
              queries: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn per query for every depth 1..k.

    The first ``k`` candidates form a set: a repeated candidate counts once, at
    its first rank.  Hits are found by one join and accumulated over the (at
    most ``k``) ranks of a query.  ``queries`` names queries whose list may be empty.
    """
    key = [*by, "query"]
    truth = truth.select("query", "cand").distinct()
    n_truth = truth.groupBy("query").agg(F.count(F.lit(1)).alias("n_truth"))
    top = candidates.filter(F.col("rank") <= k).groupBy(*key, "cand").agg(F.min("rank").alias("k"))
    marked = top.join(truth.withColumn("hit", F.lit(1)), ["query", "cand"], "left")
    per_rank = marked.groupBy(*key, "k").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("found"))
    asked = (candidates if queries is None else queries).select(*key).distinct().join(n_truth, "query")
    depths = asked.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))
    so_far = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    filled = depths.join(per_rank, [*key, "k"], "left").fillna(0, ["hits", "found"])
    tp, found = F.sum("hits").over(so_far), F.sum("found").over(so_far)
    return filled.select(
        *key, F.col("k").cast("long").alias("k"), "n_truth", "hits",
        tp.alias("tp"), (found - tp).alias("fp"), (F.col("n_truth") - tp).alias("fn"))


def query_metrics(candidates: DataFrame, truth: DataFrame, k: int, by: tuple[str, ...] = (), ap: str = "prefix",
                  queries: DataFrame | None = None) -> DataFrame:
    """Precision, recall, R-precision, F1 and average precision per query and depth.

    ``ap="prefix"`` credits only the leading run of correct candidates;
    ``standard`` sums the precision at every hit.
    """
    if ap not in ("prefix", "standard"):
        raise ValueError(f"unknown average precision: {ap}")
    key = [*by, "query"]
    so_far = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p, r = F.col("tp") / F.col("k"), F.col("tp") / F.col("n_truth")
    correct = F.when(F.col("tp") == F.col("k"), 1.0).otherwise(0.0) if ap == "prefix" else F.col("hits") * p
    hits = hits_at_k(candidates, truth, k, by, queries)
    return hits.select(
        *key, "k", "n_truth", "tp", "fp", "fn", p.alias("p"), r.alias("r"),
        (F.col("tp") / F.least("k", "n_truth")).alias("rp"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        (F.sum(correct).over(so_far) / F.col("n_truth")).alias("ap"))


def metrics_at_k(candidates: DataFrame, truth: DataFrame, k: int, by: tuple[str, ...] = (), ap: str = "prefix",
                 queries: DataFrame | None = None) -> DataFrame:
    """Per depth: macro precision, micro recall, macro R-precision and F1, mean average precision."""
    return query_metrics(candidates, truth, k, by, ap, queries).groupBy(*by, "k").agg(
        F.avg("p").alias("precision"), (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("recall"),
        F.avg("rp").alias("r_precision"), F.avg("f1").alias("f1"), F.avg("ap").alias("map"))


def mean_precision(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the precisions over all depths of ``metrics_at_k``."""
    return metrics.groupBy(*by).agg(F.avg("precision").alias("mean_precision"))


def query_report(metrics: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One wide row per query: ``P@1..k, R@1..k, AP@1..k``."""
    wide = metrics.groupBy(*by, "query").pivot("k", list(range(1, k + 1))).agg(
        F.first("p").alias("P"), F.first("r").alias("R"), F.first("ap").alias("AP"))
    named = [F.col(f"`{i}_{m}`").alias(f"{m}@{i}") for m in ("P", "R", "AP") for i in range(1, k + 1)]
    return wide.select(*by, "query", *named)


def distribution(metrics: DataFrame, measure: str = "r", bins: int = 10, step: int = 1,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Histogram of a measure pooled over the depths that ``step`` divides.

    Equal-width bins between the smallest and the largest value, the last one
    closed; empty bins are listed with 0.
    """
    pooled = metrics.filter(F.col("k") % step == 0).select(*by, F.round(measure, 9).alias("x"))
    grouped = pooled.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("n"))
    if not by:
        grouped = grouped.withColumn("_all", F.lit("all"))
    key = list(by) or ["_all"]
    ends = grouped.groupBy(*key).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    # A histogram of one repeated value is centred on it, one unit wide.
    half = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ends = ends.select(*key, (F.col("lo") - half).alias("lo"),
                       ((F.col("hi") - F.col("lo") + 2 * half) / bins).alias("width"))
    slots = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    at = F.least(F.floor(F.round((F.col("x") - F.col("lo")) / F.col("width"), 9)), F.lit(bins - 1)).cast("int")
    counted = grouped.join(ends, key).withColumn("bin", at).groupBy(*key, "bin").agg(F.sum("n").alias("n"))
    low = F.col("lo") + F.col("bin") * F.col("width")
    return slots.join(counted, [*key, "bin"], "left").select(
        *by, F.col("bin").cast("long").alias("bin"), low.alias("low"), (low + F.col("width")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"))


def filter_metrics(candidates: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean precision and recall of unranked result sets.

    Both sums are divided by the number of ground-truth queries, so an empty
    result adds 0.
    """
    key = [*by, "query"]
    truth = truth.select("query", "cand").distinct()
    n_truth = truth.groupBy("query").agg(F.count(F.lit(1)).alias("n_truth"))
    found = candidates.select(*key, "cand").distinct().join(
        truth.withColumn("hit", F.lit(1)), ["query", "cand"], "left")
    per_query = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n_found"), F.count("hit").alias("both"))
    sums = per_query.join(n_truth, "query").groupBy(*by).agg(
        F.sum(F.col("both") / F.col("n_found")).alias("p"), F.sum(F.col("both") / F.col("n_truth")).alias("r"))
    n_queries = n_truth.agg(F.count(F.lit(1))).scalar()
    return sums.select(*by, (F.col("p") / n_queries).alias("precision"), (F.col("r") / n_queries).alias("recall"))
