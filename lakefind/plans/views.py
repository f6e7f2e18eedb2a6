"""The given tables seen as a data lake, once for Spark and once as SQL.

Cell texts are written as SQL expressions that both engines share.  Some
values are read as missing so that the null-handling operators have work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakefind.functions.ranking import rank_within
from lakefind.sources.lake import table_cells, to_cells

_DEC = "CAST(CAST({0} AS DECIMAL(18,2)) AS STRING)"

# table -> (row key, {column: text expression}); row keys are dense from 0.
LAKE = {
    "region": ("r_regionkey", {"r_regionkey": "CAST(r_regionkey AS STRING)", "r_name": "r_name"}),
    "nation": ("n_nationkey", {
        "n_nationkey": "CAST(n_nationkey AS STRING)", "n_name": "n_name",
        "n_regionkey": "CAST(n_regionkey AS STRING)"}),
    "supplier": ("s_suppkey", {
        "s_suppkey": "CAST(s_suppkey AS STRING)", "s_name": "s_name",
        "s_nationkey": "CAST(NULLIF(s_nationkey, 3) AS STRING)", "s_acctbal": _DEC.format("s_acctbal")}),
    "customer": ("c_custkey", {
        "c_custkey": "CAST(c_custkey AS STRING)", "c_name": "c_name",
        "c_nationkey": "CASE WHEN c_nationkey < 15 THEN CAST(c_nationkey AS STRING) END",
        "c_acctbal": "CASE WHEN c_acctbal >= 2000 THEN " + _DEC.format("c_acctbal") + " END",
        "c_mktsegment": "NULLIF(c_mktsegment, 'BUILDING')"}),
    "part": ("p_partkey", {
        "p_partkey": "CAST(p_partkey AS STRING)", "p_name": "p_name", "p_brand": "NULLIF(p_brand, 'Brand#1')",
        "p_type": "p_type", "p_size": "CAST(p_size AS STRING)", "p_retailprice": _DEC.format("p_retailprice")}),
    "orders": ("o_orderkey", {
        "o_orderkey": "CAST(o_orderkey AS STRING)", "o_custkey": "CAST(o_custkey AS STRING)",
        "o_orderstatus": "NULLIF(o_orderstatus, 'P')", "o_totalprice": _DEC.format("o_totalprice"),
        "o_orderdate": "CAST(CAST(o_orderdate AS DATE) AS STRING)", "o_orderpriority": "o_orderpriority"}),
}


_SCHEMAS: dict[str, StructType] = {}


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A given table; its schema is inferred once per path, not by a job for every use."""
    path = f"{sf.rstrip('/')}/{table}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """All rows and the listed columns of the tables in ``LAKE`` as one lake; ``lineitem`` is left out (README)."""
    return reduce(DataFrame.unionByName, [
        table_cells(read(spark, sf, t), t, key, {c: F.expr(e) for c, e in cols.items()})
        for t, (key, cols) in LAKE.items()])


_CELLS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_id, CAST({key} AS BIGINT) AS row_idx, {i} AS col_idx, '{c}' AS col_name, "
    f"{e} AS value FROM {t}"
    for t, (key, cols) in LAKE.items() for i, (c, e) in enumerate(cols.items()))


def doc_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as text tables: one table per source, one row per document."""
    docs = read(spark, sf, "documents")
    ranked = rank_within(docs.select("source", "doc_id"), ["source"], [F.col("doc_id")], "pos")
    rows = docs.drop("source").join(ranked, "doc_id").select(
        F.col("source").alias("table_id"), (F.col("pos") - 1).alias("row_idx"),
        F.expr("NULLIF(lang, 'de')").alias("lang"), "text")
    return to_cells(rows, {"lang": F.col("lang"), "text": F.col("text")})


# The position is shifted to 0 outside the CTE that numbers it: DuckDB 2.0 applies a later filter on
# "row_number() - 1" of a shared CTE before the shift and would return 1-based positions.
_DOCS_SQL = (
    "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, "
    "NULLIF(lang, 'de') AS lang, text FROM documents")
_DOC_CELLS_SQL = (
    "SELECT source AS table_id, pos - 1 AS row_idx, 0 AS col_idx, 'lang' AS col_name, lang AS value FROM docs "
    "UNION ALL SELECT source, pos - 1, 1, 'text', text FROM docs")


def chat_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as small text tables: one table per conversation, one row per turn."""
    chat = read(spark, sf, "conversations").select(
        F.concat(F.lit("chat"), F.col("conv_id").cast("string")).alias("table_id"), F.col("turn").alias("row_idx"),
        "role", "text")
    return to_cells(chat, {"role": F.col("role"), "text": F.col("text")})


_CHAT_CELLS_SQL = (
    "SELECT 'chat' || conv_id AS table_id, turn AS row_idx, 0 AS col_idx, 'role' AS col_name, role AS value "
    "FROM conversations UNION ALL SELECT 'chat' || conv_id, turn, 1, 'text', text FROM conversations")

COLUMNS_PER_TABLE = 5


def col_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as column vectors: five consecutive vectors make one table."""
    return read(spark, sf, "embeddings").select(
        F.expr(f"concat('t', vec_id div {COLUMNS_PER_TABLE})").alias("table_id"),
        (F.col("vec_id") % COLUMNS_PER_TABLE).cast("int").alias("col_idx"),
        F.concat(F.lit("col_"), (F.col("vec_id") % COLUMNS_PER_TABLE).cast("string")).alias("col_name"),
        F.col("embedding").alias("vec"))


_COL_VECTORS_SQL = (
    f"SELECT 't' || (vec_id // {COLUMNS_PER_TABLE}) AS table_id, CAST(vec_id % {COLUMNS_PER_TABLE} AS INTEGER) AS "
    f"col_idx, 'col_' || (vec_id % {COLUMNS_PER_TABLE}) AS col_name, embedding::DOUBLE[] AS vec FROM embeddings")


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Column clusters: the label of each vector, label 9 read as noise."""
    return read(spark, sf, "embeddings").select(
        F.expr(f"concat('t', vec_id div {COLUMNS_PER_TABLE})").alias("table_id"),
        (F.col("vec_id") % COLUMNS_PER_TABLE).cast("int").alias("col_idx"),
        F.expr("CASE WHEN label = 9 THEN -1 ELSE label END").alias("cluster"))


_CLUSTERS_SQL = (
    f"SELECT 't' || (vec_id // {COLUMNS_PER_TABLE}) AS table_id, CAST(vec_id % {COLUMNS_PER_TABLE} AS INTEGER) AS "
    "col_idx, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster FROM embeddings")

CTES = {
    "cells": [("cells", _CELLS_SQL)],
    "docs": [("docs", _DOCS_SQL), ("doc_cells", _DOC_CELLS_SQL)],
    "chat": [("chat_cells", _CHAT_CELLS_SQL)],
    "vectors": [("col_vectors", _COL_VECTORS_SQL)],
    "clusters": [("clusters", _CLUSTERS_SQL)],
}


def with_views(views: list[str], *ctes: tuple[str, str], select: str) -> str:
    """``WITH`` the named views and further CTEs, then ``select``; a name ending in ``!`` is computed once."""
    parts = [cte for view in views for cte in CTES[view]] + list(ctes)
    named = [(name.removesuffix("!"), " MATERIALIZED" if name.endswith("!") else "", body) for name, body in parts]
    return "WITH " + ",\n".join(f"{name} AS{once} ({body})" for name, once, body in named) + "\n" + select
