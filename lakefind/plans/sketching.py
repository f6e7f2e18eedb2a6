"""MinHash sketches, containment estimates, the containment filter and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefind.functions.ranking import rank_within
from lakefind.operators import overlap as O
from lakefind.operators import sketch as S
from lakefind.plans.registry import query
from lakefind.plans.searching import CONTAINED, MINHASH, NUM_PERM, OVERLAP, OVERLAP_IDS, PAIRS, VALUES, _ids, found_pairs, signed_pairs, sigs
from lakefind.plans.views import cells, with_views
from lakefind.session import materialize

ESTIMATE = [
    *MINHASH, *PAIRS,
    ("est", f"""SELECT query_table, query_col, cand_table, cand_col, avg(CASE WHEN q.low = c.low THEN 1.0 ELSE 0.0 END) AS jaccard,
  {NUM_PERM} / sum(least(q.low, c.low) / 2305843009213693951.0::DOUBLE) - 1 AS union_size,
  {NUM_PERM} / sum(q.low / 2305843009213693951.0::DOUBLE) - 1 AS query_size
FROM pairs JOIN sigs q ON q.table_id = query_table AND q.col_idx = query_col JOIN sigs c ON c.table_id = cand_table AND
  c.col_idx = cand_col AND c.i = q.i GROUP BY 1, 2, 3, 4"""),
    # results add 1e-9 before they are rounded: estimates are often exact decimal ties
    ("contained", "SELECT *, jaccard * union_size / query_size AS containment FROM est"),
]


def estimates(spark, sf):
    return S.estimate(*signed_pairs(spark, sf))


@query("minhash_signatures", with_views(["cells"], *MINHASH, select=(
    "SELECT table_id, CAST(col_idx AS BIGINT) AS col_idx, i AS at, low FROM sigs")))
def _(spark, sf):
    return sigs(spark, sf).select("table_id", F.col("col_idx").cast("long"), F.posexplode("sig").alias("at", "low")).withColumn(
        "at", F.col("at").cast("long"))


@query("jaccard_estimates", with_views(["cells"], *ESTIMATE, select=(
    f"SELECT {OVERLAP_IDS}, round(jaccard, 6) AS jaccard FROM est")))
def _(spark, sf):
    return _ids(estimates(spark, sf), F.round("jaccard", 6).alias("jaccard"))


@query("union_size_estimates", with_views(["cells"], *ESTIMATE, select=(
    f"SELECT {OVERLAP_IDS}, round(union_size, 3) AS union_size, round(query_size, 3) AS query_size FROM est")))
def _(spark, sf):
    return _ids(estimates(spark, sf), F.round("union_size", 3).alias("union_size"), F.round("query_size", 3).alias("query_size"))


@query("containment_estimates", with_views(["cells"], *ESTIMATE, select=(
    f"SELECT {OVERLAP_IDS}, round(containment + 1e-9, 6) AS containment FROM contained")))
def _(spark, sf):
    return _ids(estimates(spark, sf), F.round(F.col("containment") + 1e-9, 6).alias("containment"))


# Bands and rows are tuned per size ratio on the same grid that the operator integrates over.
FILTER = [
    *OVERLAP,
    ("sized", "SELECT *, floor((row_number() OVER w - 1) * 32 / count(*) OVER (PARTITION BY query_table, query_col)) AS part "
              "FROM measured WINDOW w AS (PARTITION BY query_table, query_col ORDER BY size_2, cand_table, cand_col)"),
    ("tops", "SELECT query_table, query_col, part, max(size_2) / any_value(size_1) AS ratio FROM sized GROUP BY 1, 2, 3"),
    ("steps", "SELECT ratio, true AS below, i * 0.01::DOUBLE + 0.005::DOUBLE AS t FROM (SELECT ratio, unnest(range(0, CAST(ceil("
              "least(0.5, ratio) / 0.01) AS BIGINT))) AS i FROM (SELECT DISTINCT ratio FROM tops)) UNION ALL "
              "SELECT ratio, false, 0.5::DOUBLE + i * 0.01::DOUBLE + 0.005::DOUBLE FROM (SELECT ratio, unnest(range(0, "
              "CAST(greatest(0, ceil((least(1, ratio) - 0.5) / 0.01)) AS BIGINT))) AS i FROM (SELECT DISTINCT ratio FROM tops))"),
    ("shapes", "SELECT r, unnest(range(1, 128 // r + 1)) AS b FROM (SELECT unnest(range(1, 9)) AS r)"),
    ("met", "SELECT ratio, b, r, below, 1 - (1 - least(1, greatest(0, t / (1 + ratio - t))) ** r) ** b AS p FROM steps, shapes"),
    ("errors", "SELECT ratio, b, r, round(sum(CASE WHEN below THEN p ELSE 1 - p END) * 0.01, 9) AS e FROM met GROUP BY 1, 2, 3"),
    ("tuned", "SELECT ratio, b, r FROM (SELECT *, row_number() OVER (PARTITION BY ratio ORDER BY e, b, r) AS rn FROM errors) "
              "WHERE rn = 1"),
    ("banded", "SELECT s.query_table, s.query_col, s.cand_table, s.cand_col, q.i // r AS band, bool_and(q.low = c.low) AS same "
               "FROM sized s JOIN tops p ON s.query_table = p.query_table AND s.query_col = p.query_col AND s.part = p.part "
               "JOIN tuned t ON t.ratio = p.ratio JOIN sigs q ON q.table_id = s.query_table AND q.col_idx = s.query_col "
               "JOIN sigs c ON c.table_id = s.cand_table AND c.col_idx = s.cand_col AND c.i = q.i WHERE q.i < b * r "
               "GROUP BY 1, 2, 3, 4, 5"),
    ("kept", "SELECT DISTINCT query_table, query_col, cand_table, cand_col FROM banded WHERE same"),
]


@query("containment_filter", with_views(["cells"], *FILTER, select=f"SELECT {OVERLAP_IDS} FROM kept"))
def _(spark, sf):
    sets = O.value_sets(cells(spark, sf))
    kept = S.containment_filter(S.minhash(sets, NUM_PERM), O.set_sizes(sets), found_pairs(spark, sf), threshold=0.5, num_perm=NUM_PERM)
    return _ids(kept)


@query("containment_filter_verified", with_views(["cells"], *FILTER, select=(
    f"SELECT {OVERLAP_IDS}, round(c, 6) AS containment FROM kept JOIN measured USING (query_table, query_col, cand_table, "
    "cand_col) WHERE c >= 0.5")))
def _(spark, sf):
    kept = S.verified_filter(O.value_sets(cells(spark, sf)), found_pairs(spark, sf), threshold=0.5, num_perm=NUM_PERM)
    return _ids(kept, F.round(F.col("containment") + 1e-9, 6).alias("containment"))


OLD = "row_number() OVER (PARTITION BY query_table, query_col ORDER BY cand_table, cand_col) AS old_rank"


@query("rerank_by_containment", with_views(["cells"], *ESTIMATE, ("listed", f"SELECT *, {OLD} FROM contained"), select=f"""
SELECT {OVERLAP_IDS}, old_rank, round(containment + 1e-9, 6) AS containment, row_number() OVER (PARTITION BY query_table, query_col
  ORDER BY round(containment, 9) DESC, old_rank) AS rank FROM listed"""))
def _(spark, sf):
    signatures, pairs = signed_pairs(spark, sf)
    listed = rank_within(pairs, ["query_table", "query_col"], [F.col("cand_table"), F.col("cand_col")], "rank")
    ranked = S.rerank(listed, S.estimate(signatures, pairs))
    return _ids(ranked, "old_rank", F.round(F.col("containment") + 1e-9, 6).alias("containment"), "rank")


@query("candidate_pairs", with_views(["cells"], *MINHASH, *PAIRS, select=f"SELECT {OVERLAP_IDS} FROM pairs"))
def _(spark, sf):
    return _ids(found_pairs(spark, sf))


# Every pair of columns that share a value, whatever an index finds.
HELD = [
    VALUES,
    ("sizes", "SELECT table_id, col_idx, count(*) AS n FROM vals GROUP BY 1, 2"),
    ("held", "SELECT a.table_id AS query_table, a.col_idx AS query_col, b.table_id AS cand_table, b.col_idx AS cand_col, "
             "count(*) AS join_size FROM vals a JOIN vals b ON a.value = b.value AND a.table_id <> b.table_id GROUP BY 1, 2, 3, 4"),
]


@query("containment_pairs", with_views(["cells"], *HELD, select=(
    f"SELECT {OVERLAP_IDS}, round(join_size / n, 6) AS containment FROM held JOIN sizes ON table_id = query_table AND "
    "col_idx = query_col WHERE join_size / n >= 0.5")))
def _(spark, sf):
    """Containing columns with their exact containment."""
    return _ids(S.containment_pairs(O.value_sets(cells(spark, sf)), 0.5), F.round("containment", 6).alias("containment"))


@query("search_filter_rerank", with_views(["cells"], *FILTER, *ESTIMATE[-2:], ("again", "SELECT e.*, row_number() OVER (PARTITION BY query_table, "
    "query_col ORDER BY round(containment, 9) DESC, cand_table, cand_col) AS rank FROM contained e JOIN kept USING (query_table, query_col, "
    "cand_table, cand_col)"), select=f"SELECT {OVERLAP_IDS}, round(containment + 1e-9, 6) AS containment, rank FROM again"))
def _(spark, sf):
    """Candidates found by the containment index, filtered by size-tuned bands, ordered by estimated containment."""
    sets = materialize(O.value_sets(cells(spark, sf)))
    signatures = materialize(S.minhash(sets, NUM_PERM))
    kept = S.containment_filter(signatures, O.set_sizes(sets), S.candidate_pairs(sets, signatures, CONTAINED), 0.5, num_perm=NUM_PERM)
    listed = rank_within(kept, ["query_table", "query_col"], [F.col("cand_table"), F.col("cand_col")], "rank")
    ranked = S.rerank(listed, S.estimate(signatures, kept))
    return _ids(ranked, F.round(F.col("containment") + 1e-9, 6).alias("containment"), "rank")
