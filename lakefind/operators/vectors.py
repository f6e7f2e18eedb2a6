"""Shaping column vectors: flattening, ordinals, cleaning and pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefind.functions.ranking import rank_within
from lakefind.functions.vectors import has_nan

POOLS = {"mean": F.avg, "sum": F.sum, "max": F.max}


def table_ordinals(vectors: DataFrame) -> DataFrame:
    """``(table_id, index)``: 0-based ordinal of each table by id."""
    ranked = rank_within(vectors.select("table_id").distinct(), [], [F.col("table_id")], "index")
    return ranked.withColumn("index", F.col("index") - 1)


def flatten(matrices: DataFrame) -> DataFrame:
    """One row per column from ``(table_id, matrix)``, with the table ordinal and ``col_i`` names."""
    rows = matrices.select("table_id", F.posexplode("matrix").alias("col_idx", "vec"))
    return rows.join(table_ordinals(matrices), "table_id").select(
        "index", "table_id", "col_idx", F.concat(F.lit("col_"), F.col("col_idx").cast("string")).alias("col_name"),
        "vec")


def offsets(col_vectors: DataFrame) -> DataFrame:
    """``(table_id, index, length)`` per table."""
    lengths = col_vectors.groupBy("table_id").agg(F.count(F.lit(1)).alias("length"))
    return lengths.join(table_ordinals(col_vectors), "table_id").select("table_id", "index", "length")


def drop_nan(col_vectors: DataFrame) -> DataFrame:
    """Vectors without any NaN component."""
    return col_vectors.filter(~has_nan(F.col("vec")))


def nan_counts(col_vectors: DataFrame) -> DataFrame:
    """How many vectors are usable and how many hold a NaN."""
    bad = has_nan(F.col("vec"))
    return col_vectors.agg(F.count_if(~bad).alias("n_valid"), F.count_if(bad).alias("n_nan"))


def pool_components(col_vectors: DataFrame, method: str = "max") -> DataFrame:
    """``(table_id, dim, x)``: a table's column vectors pooled per dimension, partial sums first."""
    if method not in POOLS:
        raise ValueError(f"unknown pooling method: {method}")
    parts = col_vectors.select("table_id", F.posexplode("vec").alias("dim", "x"))
    return parts.groupBy("table_id", "dim").agg(POOLS[method](F.col("x").cast("double")).alias("x"))


def pool(col_vectors: DataFrame, method: str = "max") -> DataFrame:
    """One pooled vector per table, in the ``col_vectors`` shape (``col_idx`` 0)."""
    ordered = F.sort_array(F.collect_list(F.struct("dim", "x")))  # as long as the vector
    return (
        pool_components(col_vectors, method).groupBy("table_id").agg(ordered.alias("parts"))
        .select("table_id", F.lit(0).alias("col_idx"), F.transform("parts", lambda p: p["x"]).alias("vec"))
    )
