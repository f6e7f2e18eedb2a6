"""Exact value overlap of column pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakefind.session import materialize

SALTS = 16  # slices of a column's values
PAIR = ["query_table", "query_col", "cand_table", "cand_col"]

# Fixed values: (quality, containment at least, cardinality ratio at least), best first.
QUALITY_BANDS = [(4, 0.75, 1 / 4), (3, 0.5, 1 / 8), (2, 0.25, 1 / 12), (1, 0.1, 0.0)]


def value_sets(cells: DataFrame) -> DataFrame:
    """Distinct non-missing values of every column."""
    return cells.filter(F.col("value").isNotNull()).select("table_id", "col_idx", "value").distinct()


def set_sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("table_id", "col_idx").agg(F.count(F.lit(1)).alias("n_distinct"))


def quality(containment: Column, size_1: Column, size_2: Column) -> Column:
    """Join quality 0..4 from containment and the ratio of the two cardinalities."""
    ratio = F.least(size_1, size_2) / F.greatest(size_1, size_2)
    band = F.lit(0)
    for level, contained, least_ratio in reversed(QUALITY_BANDS):
        band = F.when((containment >= contained) & (ratio >= least_ratio), F.lit(level)).otherwise(band)
    return band


def join_profile(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sizes, shared distinct values, containment and quality of the listed column pairs.

    Only columns of the pairs are looked at.  The values of a query column are dealt over
    ``SALTS`` slices by hash, each of which meets a copy of the (short) pair list, so a huge column is not one
    key; then they are looked up at the partners by ``(column, value)``, a key as fine as the
    values.  No pair that was not asked for is formed.
    """
    pairs = materialize(pairs.select(*PAIR).distinct())
    used = pairs.select(F.col("query_table").alias("table_id"), F.col("query_col").alias("col_idx")).union(
        pairs.select("cand_table", "cand_col")).distinct()
    sets = materialize(sets.join(used, ["table_id", "col_idx"], "left_semi"))
    sizes = set_sizes(sets)
    slices = pairs.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = slices.join(
        sets.select(F.col("table_id").alias("query_table"), F.col("col_idx").alias("query_col"), "value",
                    F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int").alias("_slice")),
        ["query_table", "query_col", "_slice"]).drop("_slice")
    present = sets.select(F.col("table_id").alias("cand_table"), F.col("col_idx").alias("cand_col"), "value")
    shared = asked.join(present, ["cand_table", "cand_col", "value"]).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("join_size"))
    q = sizes.select(F.col("table_id").alias("query_table"), F.col("col_idx").alias("query_col"),
                     F.col("n_distinct").alias("size_1"))
    c = sizes.select(F.col("table_id").alias("cand_table"), F.col("col_idx").alias("cand_col"),
                     F.col("n_distinct").alias("size_2"))
    out = (
        pairs.join(q, ["query_table", "query_col"], "left").join(c, ["cand_table", "cand_col"], "left")
        .join(shared, PAIR, "left")
        .fillna(0, ["size_1", "size_2", "join_size"])
    )
    contained = F.when(F.col("size_1") > 0, F.col("join_size") / F.col("size_1"))
    return out.select(*PAIR, "size_1", "size_2", "join_size", contained.alias("containment")).withColumn(
        "quality", quality(F.col("containment"), F.col("size_1"), F.col("size_2")))


def containment(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """|Q ∩ T| / |Q| of the listed pairs; null for an empty query column."""
    return join_profile(sets, pairs).select(*PAIR, "containment")
