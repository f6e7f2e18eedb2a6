"""Lake profiling over the keyed tables, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefind.operators import profile as P
from lakefind.plans.registry import query
from lakefind.plans.selection import TYPES
from lakefind.plans.views import cells, doc_cells, read, with_views
from lakefind.sources.lake import table_cells

COLUMNS = [
    (TYPES[0], TYPES[1].format("cells")),
    ("columns_", "SELECT table_id, col_idx, col_name, count(*) AS n_rows, count(*) - count(value) AS n_null, "
                 "count(*) FILTER (regexp_matches(value, '[0-9]')) AS n_digit FROM cells GROUP BY 1, 2, 3"),
    ("profile", "SELECT c.*, dtype, n_digit > 1 AS is_numeric FROM columns_ c JOIN types t ON c.table_id = t.table_id "
                "AND c.col_idx = t.col_idx"),
]


def _profile_query(name: str, field: str, sql_field: str | None = None):
    @query(name, with_views(["cells"], *COLUMNS, select=f"SELECT table_id, col_name, {sql_field or field} FROM profile"))
    def _(spark, sf):
        return P.profile_columns(cells(spark, sf)).selectExpr("table_id", "col_name", field)


_profile_query("column_null_counts", "n_null")
_profile_query("column_digit_counts", "n_digit")
_profile_query("column_numeric_flags", "CAST(numeric AS INT) AS is_numeric",
               "CAST(is_numeric AS INTEGER) AS is_numeric")
_profile_query("column_dtypes", "dtype")


@query("table_dtype_counts", with_views(["cells"], *COLUMNS, select=(
    "SELECT table_id, count(*) FILTER (dtype = 'int') AS n_int, count(*) FILTER (dtype = 'float') AS n_float, "
    "count(*) FILTER (dtype = 'object') AS n_object FROM profile GROUP BY 1")))
def _(spark, sf):
    return P.column_types(cells(spark, sf)).groupBy("table_id").agg(
        *[F.count_if(F.col("dtype") == t).alias(f"n_{t}") for t in ("int", "float", "object")])


@query("table_shapes", with_views(["cells"], *COLUMNS, select=(
    "SELECT table_id, max(n_rows) AS n_rows, count(*) AS n_cols FROM profile GROUP BY 1")))
def _(spark, sf):
    return P.profile_tables(cells(spark, sf))


LAKE_OF = "CASE WHEN table_id IN ('customer', 'orders') THEN 'sales' ELSE 'master' END"


@query("lake_summary", with_views(["cells"], *COLUMNS, ("tables_", f"""
SELECT {LAKE_OF} AS lake, table_id, max(n_rows) AS n_rows, count(*) AS n_cols, sum(n_null) AS nulls,
  count(*) FILTER (NOT is_numeric) AS cols_non_numeric, count(*) FILTER (is_numeric) AS cols_numeric,
  count(*) FILTER (dtype = 'float') AS float64_cols, count(*) FILTER (dtype = 'int') AS int64_cols,
  count(*) FILTER (dtype = 'object') AS object_cols
FROM profile GROUP BY 1, 2"""), select="""
SELECT lake, count(*) AS ttl_files, CAST(sum(n_rows) AS BIGINT) AS ttl_rows, CAST(sum(n_cols) AS BIGINT) AS ttl_cols,
  max(n_rows) AS max_row, min(n_rows) AS min_row, max(n_cols) AS max_col, min(n_cols) AS min_col,
  round(avg(n_rows), 6) AS avg_row, round(avg(n_cols), 6) AS avg_col, CAST(sum(nulls) AS BIGINT) AS nulls,
  CAST(sum(cols_non_numeric) AS BIGINT) AS cols_non_numeric, CAST(sum(cols_numeric) AS BIGINT) AS cols_numeric,
  CAST(sum(float64_cols) AS BIGINT) AS float64_cols, CAST(sum(int64_cols) AS BIGINT) AS int64_cols,
  CAST(sum(object_cols) AS BIGINT) AS object_cols
FROM tables_ GROUP BY 1"""))
def _(spark, sf):
    lake = cells(spark, sf).withColumn("lake", F.expr(LAKE_OF))
    return P.profile_lake(lake, "lake").withColumns(
        {c: F.round(c, 6) for c in ("avg_row", "avg_col")})


QUERY_SUMMARY = """CAST(sum(n_null) AS BIGINT) AS nulls, count(*) FILTER (NOT is_numeric) AS cols_non_numeric,
  count(*) FILTER (is_numeric) AS cols_numeric FROM profile"""


@query("query_column_stats", with_views(["cells"], *COLUMNS, select=f"""
SELECT {LAKE_OF} AS benchmark, count(*) AS ttl_queries, {QUERY_SUMMARY}
WHERE regexp_matches(col_name, 'key$') GROUP BY 1"""))
def _(spark, sf):
    lake = cells(spark, sf)
    queries = lake.filter(F.col("col_name").endswith("key")).select(
        F.expr(LAKE_OF).alias("benchmark"), "table_id", "col_name")
    return P.profile_query_columns(lake, queries)


@query("query_table_stats", with_views(["cells"], *COLUMNS, select=f"""
SELECT {LAKE_OF} AS benchmark, count(DISTINCT table_id) AS ttl_queries, {QUERY_SUMMARY} GROUP BY 1"""))
def _(spark, sf):
    lake = cells(spark, sf)
    queries = lake.select(F.expr(LAKE_OF).alias("benchmark"), "table_id").distinct()
    files = lake.withColumn("table_id", F.concat("table_id", F.lit(".csv")))
    return P.profile_query_tables(files, queries)


TEXT = [
    ("gaps", "SELECT table_id, row_idx FROM doc_cells GROUP BY 1, 2 HAVING count(*) = count(value)"),
    ("whole", "SELECT value FROM doc_cells JOIN gaps USING (table_id, row_idx)"),
]
WORDS = [*TEXT, ("words", "SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(value), "
                          "'[\\p{L}\\p{N}_]+')) AS word FROM whole) WHERE NOT regexp_matches(word, '\\p{N}') AND "
                          "word NOT IN (" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + ") GROUP BY 1")]


@query("word_counts", with_views(["docs"], *WORDS, select="SELECT word, cnt FROM words"))
def _(spark, sf):
    return P.word_counts(doc_cells(spark, sf))


@query("top_words", with_views(["docs"], *WORDS, select="SELECT word, cnt FROM words ORDER BY cnt DESC, word LIMIT 50"))
def _(spark, sf):
    return P.word_counts(doc_cells(spark, sf), top=50)


def page_cells(spark, sf):
    return table_cells(read(spark, sf, "pages"), "pages", "page_id", {"url": F.col("url"), "html": F.col("html")})


ENTITIES = [
    ("texts", "SELECT url AS value FROM pages WHERE html IS NOT NULL UNION ALL SELECT html FROM pages "
              "WHERE url IS NOT NULL"),
    ("entities", "SELECT text, label, count(*) AS cnt FROM (" + " UNION ALL ".join(
        f"SELECT unnest(regexp_extract_all(value, '{pattern}')) AS text, '{label}' AS label FROM texts"
        for label, pattern in P.ENTITY_RULES.items()) + ") GROUP BY 1, 2"),
]


def _entity_sql(select: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in ENTITIES) + " " + select


@query("entity_counts", _entity_sql("SELECT text, label, cnt FROM entities"))
def _(spark, sf):
    return P.entity_counts(page_cells(spark, sf))


@query("top_entities", _entity_sql("SELECT text, label, cnt FROM entities ORDER BY cnt DESC, text, label LIMIT 50"))
def _(spark, sf):
    return P.entity_counts(page_cells(spark, sf), top=50)


@query("entity_label_sums", _entity_sql(
    "SELECT label, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n_texts FROM entities GROUP BY 1"))
def _(spark, sf):
    return P.entity_labels(P.entity_counts(page_cells(spark, sf)))
