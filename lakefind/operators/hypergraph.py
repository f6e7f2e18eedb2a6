"""Tables as hypergraphs and column vectors from hashed tokens.

Cells are nodes; the table, its columns and its rows are hyperedges.  Vectors
are kept as sparse components ``(id, dim, x)`` so that every step is a join and
a grouped sum.  Weights of a trained encoder are an external input and not
part of this library: all incidences weigh the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakefind.functions import text as T
from lakefind.functions.ranking import attach
from lakefind.session import materialize


def numbered_cells(cells: DataFrame) -> DataFrame:
    """All cells with node and edge numbers: edge 0 table, ``1..C`` columns, then rows.

    A caller that wants a size cap applies ``select.cap`` before.
    """
    widths = cells.groupBy("table_id").agg((F.max("col_idx") + 1).alias("n_cols"))
    numbered = attach(cells, widths, ["table_id"], ["row_idx", "col_idx"])
    return numbered.withColumn("node_id", F.col("row_idx") * F.col("n_cols") + F.col("col_idx"))


def nodes(numbered: DataFrame) -> DataFrame:
    return numbered.select("table_id", "node_id", "row_idx", "col_idx", T.fill_missing(F.col("value")).alias("text"))


def incidence(numbered: DataFrame) -> DataFrame:
    """Three rows per cell: its table, column and row edge."""
    edges = F.array(F.lit(0).cast("long"), (F.col("col_idx") + 1).cast("long"), F.col("row_idx") + 1 + F.col("n_cols"))
    return numbered.select("table_id", "node_id", F.explode(edges).alias("edge_id"))


def hyperedges(numbered: DataFrame) -> DataFrame:
    """``(table_id, edge_id, kind, text)``; the table edge carries the caption tag."""
    table = numbered.select("table_id", F.lit(0).cast("long").alias("edge_id"), F.lit("table").alias("kind"),
                          F.lit(T.MISSING["caption"]).alias("text")).distinct()
    column = numbered.select("table_id", (F.col("col_idx") + 1).cast("long").alias("edge_id"),
                           F.lit("column").alias("kind"),
                           T.fill_missing(F.col("col_name"), "header").alias("text")).distinct()
    row = numbered.select("table_id", (F.col("row_idx") + 1 + F.col("n_cols")).alias("edge_id"),
                        F.lit("row").alias("kind"), F.lit(T.MISSING["row"]).alias("text")).distinct()
    return table.unionByName(column).unionByName(row)


def tokens(text: Column) -> Column:
    """Word tokens of a cell, numbers in scientific form; none for a missing tag."""
    plain = F.when(~text.isin(list(T.MISSING.values())), text)
    return T.words(T.scientific_numbers(T.strip_delete(plain)))


def _signed_tokens(items: DataFrame, ids: list[str], dim: int) -> DataFrame:
    """``(ids, dim, _x)``: a row per token of an item; they add up to the mean of the tokens' signed one-hot vectors.

    An item without tokens, or a missing tag, is its own token.  The number of
    tokens is known before they are expanded, so a grouped sum is all that follows.
    """
    listed = items.select(*ids, "text", tokens(F.col("text")).alias("_tokens"))
    sized = listed.select(*ids, "text", "_tokens", F.greatest(F.coalesce(F.size("_tokens"), F.lit(1)), F.lit(1)).alias("_n"))
    each = sized.select(*ids, "text", "_n", F.explode_outer("_tokens").alias("_token"))
    code = F.md5(F.coalesce("_token", "text"))
    slot = F.conv(F.substring(code, 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.substring(code, 9, 1) < "8", 1.0).otherwise(-1.0)
    return each.select(*ids, slot.cast("int").alias("dim"), (sign / F.col("_n")).alias("_x"))


def hashed_components(items: DataFrame, ids: list[str], dim: int = 64) -> DataFrame:
    """``(ids, dim, x)``: mean of the signed one-hot vectors of an item's tokens."""
    return _signed_tokens(items, ids, dim).groupBy(*ids, "dim").agg(F.sum("_x").alias("x"))


def _fuse(own: DataFrame, gathered: DataFrame) -> DataFrame:
    """Mean of an edge's own vector and what its nodes brought."""
    return own.unionByName(gathered).groupBy("table_id", "edge_id", "dim").agg((F.sum("x") / 2).alias("x"))


def _edge_means(columns: DataFrame, rows: DataFrame | None, sizes: dict[str, DataFrame]) -> DataFrame:
    """Gathered vectors of edges from node sums per column and per row; the table's come from its columns."""
    column = columns.join(sizes["column"], ["table_id", "edge_id"])
    parts = [column]
    if rows is not None:
        table = columns.groupBy("table_id", "dim").agg(F.sum("x").alias("x")).withColumn("edge_id", F.lit(0).cast("long"))
        parts += [table.join(sizes["table"], ["table_id", "edge_id"]), rows.join(sizes["row"], ["table_id", "edge_id"])]
    mean = (F.col("x") / F.col("_n")).alias("x")
    return reduce(DataFrame.unionByName, [p.select("table_id", "edge_id", "dim", mean) for p in parts])


def column_components(cells: DataFrame, dim: int = 64, rounds: int = 1) -> DataFrame:
    """``(table_id, col_idx, dim, x)`` after ``rounds`` of node -> edge -> node averaging.

    Node vectors are needed only as sums per column and per row, so they are
    never joined to the table's edge, which every cell of a table belongs to:
    of the next round's node vectors, a third is the table's vector, a third its
    column's and a third its row's.  Only real column edges are returned, and
    the last round gathers nothing else.
    """
    numbered = numbered_cells(cells)
    col_edge, row_edge = (F.col("col_idx") + 1).cast("long"), F.col("row_idx") + 1 + F.col("n_cols")
    places = numbered.select("table_id", col_edge.alias("col_edge"), row_edge.alias("row_edge"))
    edges = hyperedges(numbered)
    column_edges = edges.filter(F.col("kind") == "column")
    own = hashed_components(edges if rounds > 1 else column_edges, ["table_id", "edge_id"], dim)
    # tokens go straight into the sums per edge, which tasks begin themselves: no vector per cell is shuffled
    each = _signed_tokens(
        numbered.select("table_id", col_edge.alias("col_edge"), row_edge.alias("row_edge"),
                        T.fill_missing(F.col("value")).alias("text")), ["table_id", "col_edge", "row_edge"], dim)
    one = F.count(F.lit(1)).alias("_n")
    sizes = {"column": materialize(places.groupBy("table_id", F.col("col_edge").alias("edge_id")).agg(one)),
             "row": places.groupBy("table_id", F.col("row_edge").alias("edge_id")).agg(one)}
    sizes["table"] = sizes["column"].groupBy("table_id").agg(F.sum("_n").alias("_n")).withColumn("edge_id", F.lit(0).cast("long"))

    def summed(df: DataFrame, edge: str, x: str = "x") -> DataFrame:
        return df.groupBy("table_id", F.col(edge).alias("edge_id"), "dim").agg(F.sum(x).alias("x"))

    columns = summed(each, "col_edge", "_x")
    rows = summed(each, "row_edge", "_x") if rounds > 1 else None
    column_ids = materialize(column_edges.select("table_id", "edge_id"))
    for k in range(1, rounds):
        own = materialize(_fuse(own, _edge_means(columns, rows, sizes)))
        table = materialize(own.filter(F.col("edge_id") == 0).drop("edge_id"))
        of_col = materialize(own.join(column_ids, ["table_id", "edge_id"], "left_semi"))
        of_row = own.filter(F.col("edge_id") > 0).join(column_ids, ["table_id", "edge_id"], "left_anti")

        def spread(to: str, across: str, vectors_: DataFrame, own_: DataFrame, kind: str, table_: DataFrame) -> DataFrame:
            """Sums over the nodes of edge ``to`` of a third of their table's, own and crossing edge's vectors."""
            vectors_ = vectors_.withColumnRenamed("edge_id", across)
            if across == "row_edge":  # rows with the same columns are added up before their sum goes to each column
                crossed = places.groupBy("table_id", across).agg(F.sort_array(F.collect_list(to)).alias("_to"))
                crossing = vectors_.join(crossed, ["table_id", across]).groupBy("table_id", "_to", "dim").agg(
                    F.sum("x").alias("x")).withColumn(to, F.explode("_to"))
            else:
                crossing = places.join(vectors_, ["table_id", across])
            constant = own_.unionByName(sizes[kind].select("table_id", "edge_id").join(table_, "table_id"))
            constant = constant.join(sizes[kind], ["table_id", "edge_id"]).select(
                "table_id", "edge_id", "dim", (F.col("x") * F.col("_n")).alias("x"))
            both = summed(crossing, to).unionByName(constant)
            return both.groupBy("table_id", "edge_id", "dim").agg((F.sum("x") / 3).alias("x"))

        last = k == rounds - 1
        rows = None if last else spread("row_edge", "col_edge", of_col, of_row, "row", table)
        columns = spread("col_edge", "row_edge", of_row, of_col, "column", table)
    own_columns = own.join(column_ids, ["table_id", "edge_id"], "left_semi")
    fused = _fuse(own_columns, _edge_means(columns, None, sizes))
    return fused.select("table_id", (F.col("edge_id") - 1).cast("int").alias("col_idx"), "dim", "x")


def column_vectors(cells: DataFrame, dim: int = 64, rounds: int = 1) -> DataFrame:
    """``(table_id, col_idx, col_name, vec)``: one dense vector per column."""
    parts = column_components(cells, dim, rounds).groupBy("table_id", "col_idx").agg(
        F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("parts"))
    names = cells.select("table_id", "col_idx", "col_name").distinct()
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.coalesce(F.element_at("parts", d), F.lit(0.0)))
    return parts.join(names, ["table_id", "col_idx"]).select("table_id", "col_idx", "col_name", vec.alias("vec"))


def processed_counts(tables: DataFrame, selected: DataFrame) -> DataFrame:
    """How many tables still hold a row after row selection, and how many are skipped."""
    left = selected.select("table_id").distinct().withColumn("_has", F.lit(1))
    return tables.select("table_id").distinct().join(left, "table_id", "left").agg(
        F.count("_has").alias("n_processed"), F.count_if(F.col("_has").isNull()).alias("n_skipped"))
