"""Profiles of columns, tables, lakes, words, entities and ground truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakefind.functions.ranking import attach
from lakefind.functions.text import words

INT = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# English stop words without apostrophes (word tokens never hold one).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves what which who whom this that these those am is are was were be
been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn
haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()

# Rule entities; patterns work alike in Java and RE2.
ENTITY_RULES = {
    "DATE": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "MONEY": r"[$€£][0-9]+(?:[.,][0-9]+)*",
    "CARDINAL": r"[0-9]+(?:[.,][0-9]+)*",
    "URL": r"https?://[A-Za-z0-9./?=&_%#:-]+",
    "NAME": r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)+",
}


def profile_columns(cells: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Per column: rows, missing cells, cells with a digit, numeric flag and inferred type.

    One grouped pass with map-side partial sums.  A column is numeric when
    more than one cell holds a digit.  Types follow reader inference: missing
    cells turn an integer column into a float one, a pure boolean column is
    neither number nor object.
    """
    value, known = F.col("value"), F.col("value").isNotNull()
    all_int, all_float, all_bool = (
        F.coalesce(F.bool_and(F.when(known, test)), F.lit(default))
        for test, default in ((value.rlike(INT), True), (value.rlike(FLOAT), True),
                              (value.isin("True", "False", "TRUE", "FALSE", "true", "false"), False))
    )
    n_null = F.count_if(value.isNull())
    columns = cells.groupBy(*keys, "col_idx", "col_name").agg(
        F.count(F.lit(1)).alias("n_rows"), n_null.alias("n_null"),
        F.count_if(value.rlike("[0-9]")).alias("n_digit"),
        all_int.alias("_int"), all_float.alias("_float"), all_bool.alias("_bool"))
    dtype = (
        F.when(F.col("_bool") & (F.col("n_null") == 0), F.lit("bool"))
        .when(F.col("_int") & (F.col("n_null") == 0), F.lit("int"))
        .when(F.col("_float"), F.lit("float"))
        .otherwise(F.lit("object"))
    )
    return columns.withColumns({"numeric": F.col("n_digit") > 1, "dtype": dtype}).drop("_int", "_float", "_bool")


def column_types(cells: DataFrame) -> DataFrame:
    """``(table_id, col_idx, dtype)`` with dtype in int, float, bool, object."""
    return profile_columns(cells).select("table_id", "col_idx", "dtype")


def profile_tables(cells: DataFrame, keys: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Rows and columns per table."""
    return profile_columns(cells, keys).groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"))


def _column_sums() -> list[Column]:
    return [
        F.sum("n_null").alias("nulls"),
        F.count_if(~F.col("numeric")).alias("cols_non_numeric"),
        F.count_if(F.col("numeric")).alias("cols_numeric"),
        F.count_if(F.col("dtype") == "float").alias("float64_cols"),
        F.count_if(F.col("dtype") == "int").alias("int64_cols"),
        F.count_if(F.col("dtype") == "object").alias("object_cols"),
    ]


def profile_lake(cells: DataFrame, by: str = "lake") -> DataFrame:
    """One summary row per lake, from the per-column profile."""
    tables = profile_columns(cells, (by, "table_id")).groupBy(by, "table_id").agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"), *_column_sums())
    sums = ["nulls", "cols_non_numeric", "cols_numeric", "float64_cols", "int64_cols", "object_cols"]
    return tables.groupBy(by).agg(
        F.count(F.lit(1)).alias("ttl_files"), F.sum("n_rows").alias("ttl_rows"), F.sum("n_cols").alias("ttl_cols"),
        F.max("n_rows").alias("max_row"), F.min("n_rows").alias("min_row"),
        F.max("n_cols").alias("max_col"), F.min("n_cols").alias("min_col"),
        F.avg("n_rows").alias("avg_row"), F.avg("n_cols").alias("avg_col"),
        *[F.sum(c).alias(c) for c in sums])


def _query_summary(columns: DataFrame, n_queries: DataFrame, by: str) -> DataFrame:
    return (
        columns.groupBy(by).agg(
            F.sum("n_null").alias("nulls"), F.count_if(~F.col("numeric")).alias("cols_non_numeric"),
            F.count_if(F.col("numeric")).alias("cols_numeric"))
        .join(n_queries, by)
        .select(by, "ttl_queries", "nulls", "cols_non_numeric", "cols_numeric")
    )


def profile_query_columns(cells: DataFrame, queries: DataFrame, by: str = "benchmark") -> DataFrame:
    """Missing cells and numeric columns among the query columns ``(by, table_id, col_name)``."""
    queries = queries.select(by, "table_id", "col_name").distinct()
    n_queries = queries.groupBy(by).agg(F.count(F.lit(1)).alias("ttl_queries"))
    return _query_summary(profile_columns(cells).join(queries, ["table_id", "col_name"]), n_queries, by)


def profile_query_tables(cells: DataFrame, queries: DataFrame, by: str = "benchmark", suffix: str = ".csv") -> DataFrame:
    """The same over all columns of the query tables ``(by, table_id)``; a missing suffix is added."""
    name = F.when(F.contains("table_id", F.lit(suffix)), F.col("table_id")).otherwise(
        F.concat("table_id", F.lit(suffix)))
    queries = queries.select(by, name.alias("table_id")).distinct()
    n_queries = queries.groupBy(by).agg(F.count(F.lit(1)).alias("ttl_queries"))
    return _query_summary(profile_columns(cells).join(queries, "table_id"), n_queries, by)


def _complete_text_cells(cells: DataFrame) -> DataFrame:
    """Text cells of rows without any missing cell.

    Incomplete rows and non-text columns are found first and removed as keys,
    so long texts are not shuffled when those lists are small.
    """
    gaps = cells.filter(F.col("value").isNull()).select("table_id", "row_idx").distinct()
    other = column_types(cells).filter(F.col("dtype") != "object").select("table_id", "col_idx")
    return attach(cells.join(gaps, ["table_id", "row_idx"], "left_anti"), other, ["table_id", "col_idx"], ["row_idx"], "left_anti")


def word_counts(cells: DataFrame, stop_words: list[str] | None = None, top: int | None = None) -> DataFrame:
    """``(word, cnt)`` over the text cells of complete rows; no digits, no stop words."""
    stop_words = STOP_WORDS if stop_words is None else stop_words
    counts = (
        _complete_text_cells(cells).select(F.explode(words(F.col("value"))).alias("word"))
        .filter(~F.col("word").rlike(r"\p{N}") & ~F.col("word").isin(stop_words))
        .groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counts if top is None else counts.orderBy(F.desc("cnt"), "word").limit(top)


def entity_counts(cells: DataFrame, rules: dict[str, str] | None = None, top: int | None = None) -> DataFrame:
    """``(text, label, cnt)`` of the rule entities in the text cells of complete rows."""
    rules = rules or ENTITY_RULES
    found = F.array(*[
        F.struct(F.lit(label).alias("label"), F.regexp_extract_all("value", F.lit(pattern), F.lit(0)).alias("texts"))
        for label, pattern in rules.items()])
    counts = (
        _complete_text_cells(cells).select(F.explode(found).alias("f"))
        .select("f.label", F.explode("f.texts").alias("text"))
        .groupBy("text", "label").agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counts if top is None else counts.orderBy(F.desc("cnt"), "text", "label").limit(top)


def entity_labels(counts: DataFrame) -> DataFrame:
    """Per label: summed counts and distinct texts."""
    return counts.groupBy("label").agg(F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("n_texts"))


def truth_shape(truth: DataFrame, by: str = "benchmark") -> DataFrame:
    """Queries, name alignment, mean candidates and self-listing queries per benchmark.

    ``truth`` holds flat pairs ``(by, query_table, query_col, cand_table,
    cand_col)``; sums are partial per query before they are averaged.
    """
    is_self = (F.col("query_table") == F.col("cand_table")) & (F.col("query_col") == F.col("cand_col"))
    queries = truth.groupBy(by, "query_table", "query_col").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("query_col") == F.col("cand_col")).cast("double")).alias("aligned"),
        F.bool_or(is_self).alias("listed"))
    return queries.groupBy(by).agg(
        F.count(F.lit(1)).alias("queries_count"), F.avg("aligned").alias("alignment"),
        F.avg("n").alias("avg_number_of_candidates"), F.count_if("listed").alias("query_in_candidates"))
