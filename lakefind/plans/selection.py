"""Row and cell selection over the keyed tables and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefind.operators import select as S
from lakefind.plans.registry import query
from lakefind.plans.views import cells, doc_cells, with_views

OUT = "table_id, CAST(row_idx AS BIGINT) AS row_idx, CAST(col_idx AS BIGINT) AS col_idx, col_name, value"


def out(df):
    return df.select(
        "table_id", F.col("row_idx").cast("long"), F.col("col_idx").cast("long"), "col_name", "value")


NULLS = ("nulls", "SELECT table_id, row_idx, count(*) FILTER (value IS NULL) AS n_null FROM {0} GROUP BY 1, 2")


def _nulls(source: str) -> tuple[str, str]:
    return NULLS[0], NULLS[1].format(source)


def _renumbered(source: str, keep: str, order: str) -> list[tuple[str, str]]:
    return [
        _nulls(source),
        ("ranked", f"SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY {order}) - 1 AS new_idx "
                   f"FROM nulls WHERE {keep}"),
        ("moved", f"SELECT c.table_id, r.new_idx AS row_idx, col_idx, col_name, value FROM {source} c "
                  "JOIN ranked r ON c.table_id = r.table_id AND c.row_idx = r.row_idx"),
    ]


HASHED = "md5('42|' || table_id || '|' || row_idx), row_idx"


@query("select_complete_rows", with_views(["cells"], *_renumbered("cells", "n_null = 0", "row_idx"),
                                          select=f"SELECT {OUT} FROM moved"))
def _(spark, sf):
    return out(S.drop_null_rows(cells(spark, sf)))


@query("select_rows_max_nulls", with_views(["cells"], *_renumbered("cells", "n_null <= 2", "row_idx"),
                                           select=f"SELECT {OUT} FROM moved"))
def _(spark, sf):
    return out(S.drop_null_rows(cells(spark, sf), 2))


@query("order_rows_by_nulls", with_views(["cells"], *_renumbered("cells", "true", "n_null, row_idx"),
                                         select=f"SELECT {OUT} FROM moved"))
def _(spark, sf):
    return out(S.order_by_nulls(cells(spark, sf)))


@query("shuffle_rows", with_views(["cells"], *_renumbered("cells", "true", HASHED),
                                  select=f"SELECT {OUT} FROM moved"))
def _(spark, sf):
    return out(S.shuffle_rows(cells(spark, sf)))


def _tfidf(source: str, text: str) -> list[tuple[str, str]]:
    return [
        ("rows_", f"SELECT DISTINCT table_id, row_idx FROM {source}"),
        ("tokens", f"SELECT table_id, row_idx, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')) "
                   f"AS token FROM {source}"),
        ("tf", "SELECT table_id, row_idx, token, count(*) AS tf FROM tokens GROUP BY 1, 2, 3"),
        ("n", "SELECT table_id, count(*) AS n FROM rows_ GROUP BY 1"),
        ("idf", "SELECT d.table_id, token, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT table_id, token, count(*) "
                "AS df FROM tf GROUP BY 1, 2) d JOIN n ON d.table_id = n.table_id"),
        ("sums", "SELECT t.table_id, t.row_idx, sum(tf * idf) / sqrt(sum(tf * idf * tf * idf)) AS score FROM tf t "
                 "JOIN idf i ON t.table_id = i.table_id AND t.token = i.token GROUP BY 1, 2"),
        ("scores", "SELECT r.table_id, r.row_idx, round(coalesce(score, 0), 6) AS score FROM rows_ r LEFT JOIN sums s "
                   "ON r.table_id = s.table_id AND r.row_idx = s.row_idx"),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, row_idx) - 1 AS new_idx "
                   "FROM scores"),
        ("moved", f"SELECT c.table_id, r.new_idx AS row_idx, col_idx, col_name, value FROM {source} c "
                  "JOIN ranked r ON c.table_id = r.table_id AND c.row_idx = r.row_idx"),
    ]


@query("order_rows_by_tfidf", with_views(["docs"], *_tfidf("doc_cells", "coalesce(value, 'nan')"),
                                         select=f"SELECT {OUT} FROM moved"))
def _(spark, sf):
    return out(S.order_rows_by_tfidf(doc_cells(spark, sf)))


@query("order_rows_by_tfidf_dropna", with_views(["docs"], *_tfidf("doc_cells", "value"),
                                                select=f"SELECT {OUT} FROM moved"))
def _(spark, sf):
    return out(S.order_rows_by_tfidf(doc_cells(spark, sf), dropna=True))


@query("tfidf_row_scores", with_views(["docs"], *_tfidf("doc_cells", "value"), select=(
    "SELECT table_id, CAST(row_idx AS BIGINT) AS row_idx, score FROM scores")))
def _(spark, sf):
    return S.row_tfidf(doc_cells(spark, sf), dropna=True)


TYPES = ("types", """SELECT table_id, col_idx, CASE
  WHEN count(value) = count(*) AND bool_and(regexp_matches(value, '^[+-]?[0-9]+$')) THEN 'int'
  WHEN coalesce(bool_and(regexp_matches(value, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')), true)
  THEN 'float' ELSE 'object' END AS dtype FROM {0} GROUP BY 1, 2""")


@query("sort_columns_by_value", with_views(["cells"], (TYPES[0], TYPES[1].format("cells")), select="""
SELECT c.table_id, row_number() OVER (PARTITION BY c.table_id, c.col_idx ORDER BY value IS NULL,
  CASE WHEN dtype <> 'object' THEN TRY_CAST(value AS DOUBLE) END NULLS FIRST, value NULLS FIRST, row_idx) - 1 AS row_idx,
  CAST(c.col_idx AS BIGINT) AS col_idx, col_name, value
FROM cells c JOIN types t ON c.table_id = t.table_id AND c.col_idx = t.col_idx"""))
def _(spark, sf):
    return out(S.sort_columns_by_value(cells(spark, sf)))


@query("sort_columns_by_idf", with_views(
    ["docs"],
    ("vals", "SELECT table_id, value, count(*) AS n FROM doc_cells WHERE value IS NOT NULL GROUP BY 1, 2"),
    ("total", "SELECT table_id, sum(n) AS total FROM vals GROUP BY 1"),
    ("df", "SELECT table_id, word, sum(n) AS df FROM (SELECT table_id, n, unnest(list_distinct(regexp_extract_all("
           "lower(value), '[\\p{L}\\p{N}_]{2,}'))) AS word FROM vals) GROUP BY 1, 2"),
    ("idf", "SELECT df.table_id, word, ln((1 + total) / (1 + df)) + 1 AS idf FROM df JOIN total "
            "ON df.table_id = total.table_id"),
    ("cut", "SELECT table_id, value, unnest(string_split(trim(regexp_replace(lower(value), '[\\s\\p{Z}]+', ' ', 'g')),"
            " ' ')) AS word FROM vals"),
    ("scores", "SELECT c.table_id, value, round(avg(coalesce(idf, 0)), 6) AS score FROM cut c LEFT JOIN idf i "
               "ON c.table_id = i.table_id AND c.word = i.word GROUP BY 1, 2"),
    select="""SELECT c.table_id, row_number() OVER (PARTITION BY c.table_id, col_idx
  ORDER BY coalesce(score, -1) DESC, row_idx) - 1 AS row_idx, CAST(col_idx AS BIGINT) AS col_idx, col_name, c.value
FROM doc_cells c LEFT JOIN scores s ON c.table_id = s.table_id AND c.value = s.value"""))
def _(spark, sf):
    return out(S.sort_columns_by_idf(doc_cells(spark, sf)))


DISTINCT = [
    ("firsts", "SELECT table_id, col_idx, col_name, value, min(row_idx) AS first_idx FROM cells GROUP BY 1, 2, 3, 4"),
    ("found", "SELECT table_id, row_number() OVER (PARTITION BY table_id, col_idx ORDER BY first_idx) - 1 AS row_idx, "
              "col_idx, col_name, value FROM firsts"),
    ("cols", "SELECT table_id, col_idx, col_name, count(*) AS n FROM found GROUP BY 1, 2, 3"),
    ("longest", "SELECT table_id, max(n) AS top FROM cols GROUP BY 1"),
    ("padded", "SELECT table_id, unnest(range(n, top)) AS row_idx, col_idx, col_name, CAST(NULL AS VARCHAR) AS value "
               "FROM cols JOIN longest USING (table_id) UNION ALL SELECT table_id, row_idx, col_idx, col_name, value "
               "FROM found"),
]


@query("distinct_column_values", with_views(["cells"], *DISTINCT, select=f"SELECT {OUT} FROM padded"))
def _(spark, sf):
    return out(S.distinct_columns(cells(spark, sf)))


@query("head_rows", with_views(["cells"], select=f"SELECT {OUT} FROM cells WHERE row_idx < 30"))
def _(spark, sf):
    return out(S.head_rows(cells(spark, sf), 30))


@query("sample_rows", with_views(["cells"], *_renumbered("cells", "true", HASHED),
                                 select=f"SELECT {OUT} FROM moved WHERE row_idx < 30"))
def _(spark, sf):
    return out(S.sample_rows(cells(spark, sf), 30))


@query("rate_sample_rows", with_views(
    ["cells"],
    ("rates", "SELECT table_id, greatest(1, (max(row_idx) + 1) // 30) AS rate FROM cells GROUP BY 1"),
    select="SELECT c.table_id, CAST(row_idx // rate AS BIGINT) AS row_idx, CAST(col_idx AS BIGINT) AS col_idx, "
           "col_name, value FROM cells c JOIN rates r ON c.table_id = r.table_id WHERE row_idx % rate = 0"))
def _(spark, sf):
    return out(S.rate_sample(cells(spark, sf), 30))


@query("blank_headers", with_views(["cells"], select=(
    "SELECT table_id, col_idx, col_name, count(*) AS n_cells FROM (SELECT table_id, CAST(col_idx AS BIGINT) AS "
    "col_idx, '' AS col_name FROM cells) GROUP BY 1, 2, 3")))
def _(spark, sf):
    blank = S.blank_headers(cells(spark, sf))
    return blank.groupBy("table_id", F.col("col_idx").cast("long").alias("col_idx"), "col_name").agg(
        F.count(F.lit(1)).alias("n_cells"))


@query("blank_unnamed_headers", with_views(["cells"], select=(
    "SELECT table_id, col_idx, CASE WHEN contains(lower(trim(h)), 'unnamed') THEN '' ELSE trim(h) END AS col_name, "
    "count(*) AS n_cells FROM (SELECT table_id, CAST(col_idx AS BIGINT) AS col_idx, CASE WHEN col_idx = 1 THEN "
    "' Unnamed: 1' ELSE ' ' || col_name || ' ' END AS h FROM cells) GROUP BY 1, 2, 3")))
def _(spark, sf):
    raw = cells(spark, sf).withColumn("col_name", F.when(F.col("col_idx") == 1, F.lit(" Unnamed: 1")).otherwise(
        F.concat(F.lit(" "), "col_name", F.lit(" "))))
    return S.blank_headers(raw, only_unnamed=True).groupBy(
        "table_id", F.col("col_idx").cast("long").alias("col_idx"), "col_name").agg(F.count(F.lit(1)).alias("n_cells"))


CAPPED = ("capped", "SELECT table_id, row_idx, col_idx, col_name, array_to_string(list_slice(string_split(trim("
                    "regexp_replace(value, '[\\s\\p{Z}]+', ' ', 'g')), ' '), 1, 64), ' ') AS value FROM doc_cells "
                    "WHERE row_idx < 64 AND col_idx < 64")


@query("cap_table_size", with_views(["docs"], CAPPED, select=f"SELECT {OUT} FROM capped"))
def _(spark, sf):
    return out(S.cap(doc_cells(spark, sf)))


# The process drops rows, renumbers and then shuffles, so the hash sees the new dense positions.
KEPT = _renumbered("cells", "n_null <= 2", "row_idx")


@query("select_rows_by_name", with_views(
    ["cells"], *KEPT,
    ("shuffled", "SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY md5('42|' || table_id || '|' || "
                 "row_idx), row_idx) AS rank FROM moved"),
    select="SELECT table_id, CAST(rank - 1 AS BIGINT) AS row_idx, CAST(col_idx AS BIGINT) AS col_idx, col_name, value "
           "FROM shuffled WHERE rank <= 30"))
def _(spark, sf):
    return out(S.select_rows(cells(spark, sf), "remove_rows_with_nulls_and_shuffle", "head", 30))
