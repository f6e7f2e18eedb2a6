"""Text normalisation, linearised tables, lexicons, corruption, hypergraphs, hashed vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakefind.functions import text as T
from lakefind.operators import corpus as C
from lakefind.operators import hypergraph as H
from lakefind.operators.select import drop_null_rows
from lakefind.plans.registry import query
from lakefind.plans.views import cells, chat_cells, doc_cells, read, with_views
from lakefind.sources.lake import to_cells

SQUEEZE = "trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def _per_doc(name: str, raw: str, expr, sql: str):
    """A text step over every document; ``raw`` puts the step's special case into the text."""

    @query(name, f"SELECT doc_id, {sql} AS value FROM (SELECT doc_id, {raw} AS raw FROM documents)")
    def _(spark, sf):
        docs = read(spark, sf, "documents").select("doc_id", F.expr(raw).alias("raw"))
        return docs.select("doc_id", expr(F.col("raw")).alias("value"))


_per_doc("strip_delete_char", "concat(lang, chr(127), text, chr(127))", T.strip_delete, "replace(raw, chr(127), '')")


def _number_sql(form: str) -> str:
    pre, post = "ltrim(regexp_extract(t, '^([0-9]+)', 1), '0')", "regexp_extract(t, '^[0-9]+\\.?([0-9]*)$', 1)"
    digits = f"rtrim({pre} || {post}, '0')" if form == "corpus" else f"{pre} || rtrim({post}, '0')"
    return (
        "array_to_string(list_transform(regexp_extract_all(raw, '[0-9]+\\.?[0-9]*|[^0-9]+'), lambda t: CASE "
        "WHEN NOT regexp_matches(t, '^[0-9]') THEN t "
        f"WHEN {pre} <> '' THEN {digits} || ' scinotexp ' || (length({pre}) - 1) "
        f"WHEN ltrim({post}, '0') <> '' THEN trim({post}, '0') || ' scinotexp ' || "
        f"(length(ltrim({post}, '0')) - length({post}) - 1) ELSE '0 scinotexp 0' END), '')")


_RAW_NUMBERS = "concat(text, ' ', n_chars, '.', doc_id, '0 0.00', doc_id, ' 100 007.250 0 0.0')"
_per_doc("scientific_numbers", _RAW_NUMBERS, T.scientific_numbers, _number_sql("corpus"))
_per_doc("scientific_numbers_search_form", _RAW_NUMBERS, lambda c: T.scientific_numbers(c, "search"), _number_sql("search"))
_per_doc("fill_missing_cells", "CASE WHEN lang = 'de' THEN NULL WHEN lang = 'fr' THEN '  ' ELSE text END",
         T.fill_missing, "CASE WHEN trim(raw) <> '' THEN raw ELSE '[CELL]' END")
_per_doc("clean_templates",
         "CASE WHEN lang = 'en' THEN concat('{{', replace(text, chr(10), '|'), '}}') ELSE concat(lang, '{{a|b}}', text) END",
         T.clean_template,
         "CASE WHEN regexp_matches(raw, '^\\{\\{.*\\}\\}$') THEN string_split(regexp_extract(raw, '^\\{\\{(.*)\\}\\}$', 1), "
         "'|')[-1] ELSE regexp_replace(raw, '\\{\\{.*\\}\\}', '', 'g') END")


def sanitize_sql(raw: str, kind: str) -> str:
    """The sanitising chain as one SQL expression."""
    out = SQUEEZE.format(f"regexp_replace({raw}, '\\|+', ' ', 'g')")
    for word in T.LEADING_MARKUP:
        out = f"regexp_replace({out}, '^{word}( |$)', '{word.lower()}~ ')"
    out = f"regexp_replace({out}, '^t[dh]~ +', '')"
    for tag in T.RESERVED:
        out = f"replace({out}, '{tag}', '')"
    out = SQUEEZE.format(out)
    return f"(CASE WHEN coalesce(lower({out}), '') IN ('', '<missing>', 'missing') THEN '{T.MISSING[kind]}' ELSE {out} END)"


_per_doc("sanitize_cells",
         "CASE WHEN lang = 'de' THEN concat('td ', text, '<row>') WHEN lang = 'fr' THEN concat('||', text, '|[CELL]|') "
         "WHEN lang = 'es' THEN ' Missing ' ELSE text END", T.sanitize, sanitize_sql("raw", "cell"))
# For these scripts dropping accents and then all non-ASCII equals compatibility folding.
_per_doc("clean_cells_ascii", "text", T.clean_cell, sanitize_sql(SQUEEZE.format(
    "regexp_replace(regexp_replace(strip_accents(raw), '[^\\x00-\\x7f]', '', 'g'), '\\{\\{.*\\}\\}', '', 'g')"), "cell"))


@query("normalize_cells", with_views(["cells"], select=(
    "SELECT table_id, row_idx, CAST(col_idx AS BIGINT) AS col_idx, "
    + _number_sql("corpus").replace("(raw,", "(v,") + " AS value FROM "
    "(SELECT *, CASE WHEN trim(value) <> '' THEN value ELSE '[CELL]' END AS v FROM cells)")))
def _(spark, sf):
    done = C.normalize_cells(cells(spark, sf), ["strip_delete", "fill_missing", "scientific_numbers"])
    return done.select("table_id", "row_idx", F.col("col_idx").cast("long"), "value")


def headed_lines(spark, sf):
    """Documents as two-column tables (language, line) that start by repeating their header.

    The header is the first line, and the language where the doc_id is even; elsewhere the first
    row only holds a longer text that contains the header, and stays.
    """
    docs = read(spark, sf, "documents").select("doc_id", "lang", F.split("text", "\n").alias("lines"))
    head = F.when(F.col("doc_id") % 2 == 0, F.col("lines")[0]).otherwise(F.substring(F.col("lines")[0], 1, 3))
    rows = docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("table_id"), "lang",
                       head.alias("head"), F.posexplode("lines").alias("row_idx", "line"))
    return to_cells(rows, {"lang": F.col("lang"), "line": F.col("line")}, {"lang": F.col("lang"), "line": F.col("head")})


@query("drop_repeated_headers", """
WITH docs_ AS (SELECT 'doc' || doc_id AS table_id, doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
rows_ AS (SELECT table_id, lang, CASE WHEN doc_id % 2 = 0 THEN l[1] ELSE substr(l[1], 1, 3) END AS head,
  unnest(range(0, len(l))) AS row_idx, unnest(l) AS line FROM docs_),
firsts AS (SELECT table_id, min(row_idx) AS f FROM rows_ WHERE NOT trim(line) = trim(head) GROUP BY 1),
moved AS (SELECT table_id, lang, head, row_idx - f AS row_idx, line FROM rows_ JOIN firsts USING (table_id) WHERE row_idx >= f)
SELECT table_id, row_idx, CAST(0 AS BIGINT) AS col_idx, lang AS col_name, lang AS value FROM moved
UNION ALL SELECT table_id, row_idx, 1, head, line FROM moved""")
def _(spark, sf):
    kept = C.drop_header_rows(headed_lines(spark, sf))
    return kept.select("table_id", "row_idx", F.col("col_idx").cast("long"), "col_name", "value")


LINEAR = [
    ("cleaned", "SELECT table_id, row_idx, col_idx, " + sanitize_sql("col_name", "header") + " AS head, "
                + sanitize_sql("value", "cell") + " AS cell FROM cells"),
    ("lines", "SELECT table_id, row_idx, string_agg(head, ' | ' ORDER BY col_idx) AS head, '<row> ' || string_agg(cell, "
              "' | ' ORDER BY col_idx) AS line FROM cleaned GROUP BY 1, 2"),
    ("texts", "SELECT table_id, row_idx // 100 AS part, '<caption> [TAB] <header> ' || min(head) || ' ' || "
              "string_agg(line, ' ' ORDER BY row_idx) AS text FROM lines GROUP BY 1, 2"),
]


@query("linearize_tables", with_views(["cells"], *LINEAR, select="SELECT table_id, part, text FROM texts"))
def _(spark, sf):
    return C.linearize(cells(spark, sf))


@query("parse_linear_tables", with_views(["cells"], *LINEAR, select=(
    "SELECT table_id, row_idx, CAST(col_idx AS BIGINT) AS col_idx, head AS col_name, cell AS value FROM cleaned "
    "WHERE table_id <> 'nation'")))
def _(spark, sf):
    # One table gets a row of the wrong width and must be skipped.
    texts = C.linearize(cells(spark, sf)).withColumn("text", F.when(
        F.col("table_id") == "nation", F.concat("text", F.lit(" <row> a | b"))).otherwise(F.col("text")))
    return C.parse_text(texts).select("table_id", "row_idx", F.col("col_idx").cast("long"), "col_name", "value")


CELL_LEX = ("cell_lex", "SELECT CASE WHEN trim(value) <> '' THEN lower(value) ELSE '[CELL]' END AS text, count(*) AS cnt "
                        "FROM cells GROUP BY 1")
HEAD_LEX = ("head_lex", "SELECT lower(col_name) AS text, count(*) AS cnt FROM (SELECT DISTINCT table_id, col_idx, col_name "
                        "FROM cells) GROUP BY 1")


@query("cell_lexicon", with_views(["cells"], CELL_LEX, select="SELECT text, cnt FROM cell_lex"))
def _(spark, sf):
    return C.lexicon(cells(spark, sf))


@query("header_lexicon", with_views(["docs", "chat"], ("cells", "SELECT * FROM doc_cells UNION ALL SELECT * FROM chat_cells"),
                                    HEAD_LEX, select="SELECT text, cnt FROM head_lex"))
def _(spark, sf):
    return C.lexicon(doc_cells(spark, sf).unionByName(chat_cells(spark, sf)), "header")


TOP_LEX = [
    ("weighed", "SELECT text, CASE WHEN text = '[CELL]' THEN 0 ELSE cnt END AS cnt FROM cell_lex"),
    ("lex_ranked", "SELECT *, row_number() OVER (ORDER BY cnt DESC, text) AS rank FROM weighed"),
    ("top_lex", "SELECT *, cnt / sum(cnt) OVER () AS p FROM lex_ranked WHERE rank <= (SELECT floor(count(*) * 0.05) FROM cell_lex)"),
]


@query("top_lexicon", with_views(["cells"], CELL_LEX, *TOP_LEX,
                                 select="SELECT text, cnt, rank, round(p, 6) AS p FROM top_lex"))
def _(spark, sf):
    return C.top_lexicon(C.lexicon(cells(spark, sf))).withColumn("p", F.round("p", 6))


PICKED = [
    ("cell_ranked", "SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY md5('42cell|' || table_id || '|' || row_idx "
                    "|| '|' || col_idx), row_idx, col_idx) AS rn, count(*) OVER (PARTITION BY table_id) AS n FROM cells"),
    ("head_ranked", "SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY md5('42head|' || table_id || '|' || col_idx), "
                    "col_idx) AS rn, count(*) OVER (PARTITION BY table_id) AS n FROM (SELECT DISTINCT table_id, col_idx, "
                    "col_name FROM cells)"),
    ("picked", "SELECT c.table_id, c.row_idx, c.col_idx, c.col_name, c.value, h.rn <= round_even(h.n * 0.3, 0) AS label_head, "
               "c.rn <= round_even(c.n * 0.3, 0) AND coalesce(trim(c.value) <> '', false) AS label_cell FROM cell_ranked c "
               "JOIN head_ranked h ON c.table_id = h.table_id AND c.col_idx = h.col_idx"),
]
CORRUPT_OUT = ("table_id, CAST(row_idx AS BIGINT) AS row_idx, CAST(col_idx AS BIGINT) AS col_idx, {0} AS col_name, {1} AS value, "
               "CAST(label_head AS INTEGER) AS label_head, CAST(label_cell AS INTEGER) AS label_cell")


def _corrupt_out(df):
    return df.withColumn("col_idx", F.col("col_idx").cast("long"))


@query("corrupt_by_mask", with_views(["cells"], *PICKED, select="SELECT " + CORRUPT_OUT.format(
    "CASE WHEN label_head THEN '[HEAD]' ELSE col_name END", "CASE WHEN label_cell THEN '[CELL]' ELSE value END") + " FROM picked"))
def _(spark, sf):
    return _corrupt_out(C.corrupt_mask(cells(spark, sf), 0.3))


def _draw_sql(lex: str, hashed: str) -> str:
    return (f"floor(('0x' || substr(md5({hashed}), 1, 13))::BIGINT / 4503599627370496.0 * "
            f"(SELECT sum(cnt) FROM {lex}))")


@query("corrupt_by_replacement", with_views(
    ["cells"], CELL_LEX, HEAD_LEX, *TOP_LEX, *PICKED,
    ("cell_cum", "SELECT text, cnt, sum(cnt) OVER (ORDER BY cnt DESC, text) AS hi FROM top_lex WHERE cnt > 0"),
    ("head_cum", "SELECT text, cnt, sum(cnt) OVER (ORDER BY cnt DESC, text) AS hi FROM head_lex WHERE cnt > 0"),
    ("placed", "SELECT *, " + _draw_sql("cell_cum", "'42cell-draw|' || table_id || '|' || row_idx || '|' || col_idx")
     + " AS cell_at, " + _draw_sql("head_cum", "'42head-draw|' || table_id || '|' || col_idx") + " AS head_at FROM picked"),
    ("drawn", "SELECT p.*, c.text AS cell_text, h.text AS head_text FROM placed p JOIN cell_cum c ON cell_at >= c.hi - c.cnt "
              "AND cell_at < c.hi JOIN head_cum h ON head_at >= h.hi - h.cnt AND head_at < h.hi"),
    select="SELECT " + CORRUPT_OUT.format("CASE WHEN label_head THEN head_text ELSE col_name END",
                                          "CASE WHEN label_cell THEN cell_text ELSE value END") + " FROM drawn"))
def _(spark, sf):
    lake = cells(spark, sf)
    words = C.top_lexicon(C.lexicon(lake))
    return _corrupt_out(C.corrupt_replace(lake, words, C.lexicon(lake, "header"), 0.3))


@query("train_valid_split", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= (SELECT floor(count(*) * 0.05)
FROM documents) THEN 'valid' ELSE 'train' END AS part FROM documents""")
def _(spark, sf):
    return C.split(read(spark, sf, "documents").select("doc_id"), ["doc_id"])


# --- hypergraphs -----------------------------------------------------------------------------

GRAPH = [
    ("widths", "SELECT table_id, max(col_idx) + 1 AS n_cols FROM cells GROUP BY 1"),
    ("numbered!", "SELECT s.*, n_cols, row_idx * n_cols + col_idx AS node_id FROM cells s JOIN widths USING (table_id)"),
    ("nodes!", "SELECT table_id, node_id, row_idx, col_idx, CASE WHEN trim(value) <> '' THEN value ELSE '[CELL]' END AS text "
              "FROM numbered"),
    ("links!", "SELECT table_id, node_id, unnest([0, col_idx + 1, row_idx + 1 + n_cols]) AS edge_id FROM numbered"),
    ("edges!", "SELECT DISTINCT table_id, 0 AS edge_id, 'table' AS kind, '[TAB]' AS text FROM numbered UNION ALL "
              "SELECT DISTINCT table_id, col_idx + 1, 'column', col_name FROM numbered UNION ALL "
              "SELECT DISTINCT table_id, row_idx + 1 + n_cols, 'row', '[ROW]' FROM numbered"),
]


def numbered(spark, sf):
    return H.numbered_cells(cells(spark, sf))


@query("hypergraph_nodes", with_views(["cells"], *GRAPH, select=(
    "SELECT table_id, node_id, row_idx, CAST(col_idx AS BIGINT) AS col_idx, text FROM nodes")))
def _(spark, sf):
    return H.nodes(numbered(spark, sf)).withColumn("col_idx", F.col("col_idx").cast("long"))


@query("hypergraph_incidence", with_views(["cells"], *GRAPH, select="SELECT table_id, node_id, edge_id FROM links"))
def _(spark, sf):
    return H.incidence(numbered(spark, sf))


@query("hypergraph_edges", with_views(["cells"], *GRAPH, select="SELECT table_id, edge_id, kind, text FROM edges"))
def _(spark, sf):
    return H.hyperedges(numbered(spark, sf))


def _view_sql(seed: int) -> str:
    return (f"CAST(row_number() OVER (PARTITION BY table_id ORDER BY md5('{seed}|' || table_id || '|' || node_id || '|' || "
            "edge_id), node_id, edge_id) <= floor(count(*) OVER (PARTITION BY table_id) * 0.7) AS INTEGER) AS view_" + str(seed))


@query("edge_drop_views", with_views(["cells"], *GRAPH, select=(
    f"SELECT table_id, node_id, edge_id, {_view_sql(1)}, {_view_sql(2)} FROM links")))
def _(spark, sf):
    return C.edge_views(H.incidence(numbered(spark, sf)))


def _components(name: str, source: str, ids: str) -> list[tuple[str, str]]:
    listed = "regexp_extract_all(lower(" + _number_sql("corpus").replace("(raw,", "(text,") + "), '[\\p{L}\\p{N}_]+')"
    return [
        (f"{name}_tokens", f"SELECT {ids}, CASE WHEN text IN ('[TAB]', '[HEAD]', '[CELL]', '[ROW]') THEN [text] ELSE {listed} "
                           f"END AS t FROM {source}"),
        (f"{name}_each", f"SELECT {ids}, 1.0::DOUBLE / len(t) AS w, unnest(t) AS token FROM {name}_tokens"),
        (f"{name}!", f"SELECT {ids}, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS dim, sum(CASE WHEN substr(md5(token), 9, 1) "
               f"< '8' THEN w ELSE -w END) AS x FROM {name}_each GROUP BY ALL"),
    ]


@query("cell_vectors", with_views(["cells"], *GRAPH, *_components("cell_vec", "nodes", "table_id, node_id"), select=(
    "SELECT table_id, node_id, dim, round(x, 6) AS x FROM cell_vec")))
def _(spark, sf):
    parts = H.hashed_components(H.nodes(numbered(spark, sf)), ["table_id", "node_id"])
    return parts.select("table_id", "node_id", F.col("dim").cast("long"), F.round("x", 6).alias("x"))


# Vectors of nodes enter only as sums per edge: a join of incidences with vectors has a row per node, edge and dimension.
ROUND = [
    *_components("cell_vec", "nodes", "table_id, node_id"), *_components("edge_vec", "edges", "table_id, edge_id"),
    ("degree!", "SELECT table_id, edge_id, count(*) AS n FROM links GROUP BY 1, 2"),
    ("at_place!", "SELECT c.table_id, dim, x, node_id % n_cols + 1 AS col_edge, node_id // n_cols + 1 + n_cols AS row_edge FROM "
                  "cell_vec c JOIN widths USING (table_id)"),
    ("of_edge", "SELECT table_id, 0 AS edge_id, dim, sum(x) AS x FROM at_place GROUP BY ALL UNION ALL SELECT table_id, col_edge, dim, "
                "sum(x) FROM at_place GROUP BY ALL UNION ALL SELECT table_id, row_edge, dim, sum(x) FROM at_place GROUP BY ALL"),
    ("gathered", "SELECT table_id, edge_id, dim, x / n AS x FROM of_edge JOIN degree USING (table_id, edge_id)"),
    ("fused!", "SELECT table_id, edge_id, dim, sum(x) / 2 AS x FROM (SELECT * FROM edge_vec UNION ALL SELECT * FROM gathered) "
               "GROUP BY 1, 2, 3"),
]
TWO_ROUNDS = [
    *ROUND,
    ("col_edges!", "SELECT table_id, edge_id, n FROM edges JOIN degree USING (table_id, edge_id) WHERE kind = 'column'"),
    ("brought", "SELECT e.table_id, e.edge_id, dim, x * n AS x FROM col_edges e JOIN fused f ON f.table_id = e.table_id AND f.edge_id "
                "IN (0, e.edge_id) UNION ALL SELECT s.table_id, s.col_idx + 1, dim, sum(x) FROM numbered s JOIN fused f ON f.table_id = "
                "s.table_id AND f.edge_id = s.row_idx + 1 + s.n_cols GROUP BY ALL"),
    ("gathered_2", "SELECT table_id, edge_id, dim, sum(x) / 3 / any_value(n) AS x FROM brought JOIN col_edges USING (table_id, edge_id) "
                   "GROUP BY 1, 2, 3"),
    ("fused_2", "SELECT table_id, edge_id, dim, sum(x) / 2 AS x FROM (SELECT * FROM fused UNION ALL SELECT * FROM gathered_2) "
                "GROUP BY 1, 2, 3"),
]


def _column_sql(source: str) -> str:
    # x is often an exact decimal tie, which the order of a float sum would round either way
    return (f"SELECT f.table_id, f.edge_id - 1 AS col_idx, dim, round(x + 1e-9, 6) + 0 AS x FROM {source} f JOIN edges e ON f.table_id "
            "= e.table_id AND f.edge_id = e.edge_id WHERE kind = 'column'")


for _name, _rounds, _ctes, _source in (("column_vector_components", 1, ROUND, "fused"),
                                       ("column_vector_components_two_rounds", 2, TWO_ROUNDS, "fused_2")):
    @query(_name, with_views(["cells"], *GRAPH, *_ctes, select=_column_sql(_source)))
    def _(spark, sf, rounds=_rounds):
        parts = H.column_components(cells(spark, sf), rounds=rounds)
        return parts.select("table_id", F.col("col_idx").cast("long"), F.col("dim").cast("long"), F.round(F.col("x") + 1e-9, 6).alias("x"))


@query("extract_column_vectors", with_views(["cells"], *GRAPH, *ROUND, ("wide", _column_sql("fused")), select=(
    "SELECT table_id, col_idx, col_name, 64::BIGINT AS n_dims, round(sum(x), 6) AS x_sum FROM wide JOIN (SELECT DISTINCT table_id, "
    "CAST(col_idx AS BIGINT) AS col_idx, col_name FROM cells) USING (table_id, col_idx) GROUP BY 1, 2, 3")))
def _(spark, sf):
    vectors = H.column_vectors(cells(spark, sf))
    rounded = F.aggregate(F.filter("vec", lambda x: x != 0), F.lit(0.0), lambda a, x: a + F.round(x + 1e-9, 6))
    return vectors.select("table_id", F.col("col_idx").cast("long"), "col_name", F.size("vec").cast("long").alias("n_dims"),
                          F.round(rounded, 6).alias("x_sum"))


def order_tables(spark, sf):
    """One table per customer, its orders as rows."""
    orders = read(spark, sf, "orders").withColumns({
        "table_id": F.concat(F.lit("customer"), F.col("o_custkey").cast("string")), "row_idx": F.col("o_orderkey")})
    return to_cells(orders, {"status": F.expr("NULLIF(o_orderstatus, 'P')"), "priority": F.col("o_orderpriority")})


@query("processed_table_counts", """
SELECT count(*) FILTER (ok) AS n_processed, count(*) FILTER (NOT ok) AS n_skipped FROM (
SELECT o_custkey, bool_or(o_orderstatus <> 'P') AS ok FROM orders GROUP BY 1)""")
def _(spark, sf):
    lake = order_tables(spark, sf)
    return H.processed_counts(lake, drop_null_rows(lake))
