"""Evaluation of ranked lists and shapes of ground truths.

Candidate lists come from ``lineitem``: every supplier queries for parts, one
method ranks them by quantity, the other by number of lines.  A part is
relevant when the supplier got it returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakefind.functions.ranking import rank_within
from lakefind.operators import evaluate as E
from lakefind.operators.profile import truth_shape
from lakefind.plans.registry import query
from lakefind.plans.views import read
from lakefind.sources.tables import group_truth

K = 10
METHODS = {"by_quantity": "sum(l_quantity)", "by_lines": "count(*)"}


def candidates(spark, sf, method: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("cand"))
    weighed = lines.agg(F.expr(METHODS[method]).alias("w"))
    return rank_within(weighed, ["query"], [F.desc("w"), F.col("cand")], "rank", limit=2 * K).select(
        F.lit(method).alias("method"), "query", "cand", "rank")


def all_candidates(spark, sf) -> DataFrame:
    return reduce(DataFrame.unionByName, [candidates(spark, sf, m) for m in METHODS])


def truth(spark, sf) -> DataFrame:
    returned = read(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
    return returned.select(F.col("l_suppkey").alias("query"), F.col("l_partkey").alias("cand")).distinct()


LISTS = [
    ("weighed", " UNION ALL ".join(
        f"SELECT '{m}' AS method, l_suppkey AS query, l_partkey AS cand, {w} AS w FROM lineitem GROUP BY 2, 3"
        for m, w in METHODS.items())),
    ("ranked", "SELECT method, query, cand, row_number() OVER (PARTITION BY method, query ORDER BY w DESC, cand) AS rank "
               "FROM weighed"),
    ("lists", f"SELECT * FROM ranked WHERE rank <= {2 * K}"),
    ("truth", "SELECT DISTINCT l_suppkey AS query, l_partkey AS cand FROM lineitem WHERE l_returnflag = 'R'"),
    ("n_truth", "SELECT query, count(*) AS n_truth FROM truth GROUP BY 1"),
    ("marked", "SELECT l.*, CASE WHEN t.cand IS NULL THEN 0 ELSE 1 END AS hit FROM lists l LEFT JOIN truth t "
               "ON l.query = t.query AND l.cand = t.cand"),
    ("depths", f"SELECT method, query, n_truth, unnest(range(1, {K} + 1)) AS k FROM (SELECT DISTINCT method, query "
               "FROM lists) JOIN n_truth USING (query)"),
    ("hits", "SELECT d.method, d.query, d.k, n_truth, CAST(sum(hit) AS BIGINT) AS tp, CAST(count(*) - sum(hit) AS "
             "BIGINT) AS fp, CAST(n_truth - sum(hit) AS BIGINT) AS fn, max(CASE WHEN m.rank = d.k THEN hit END) AS hit "
             "FROM depths d JOIN marked m ON d.method = m.method AND d.query = m.query AND m.rank <= d.k "
             "GROUP BY 1, 2, 3, 4"),
    ("measured", "SELECT *, tp / k AS p, tp / n_truth AS r, tp / least(k, n_truth) AS rp, CASE WHEN tp > 0 THEN "
                 "2 * (tp / k) * (tp / n_truth) / (tp / k + tp / n_truth) ELSE 0 END AS f1, sum(CASE WHEN tp = k THEN "
                 "1.0 ELSE 0 END) OVER w / n_truth AS ap, sum(hit * tp / k) OVER w / n_truth AS ap_standard FROM hits "
                 "WINDOW w AS (PARTITION BY method, query ORDER BY k)"),
]


def _sql(select: str, *more: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in [*LISTS, *more]) + "\n" + select


def _metrics(spark, sf, ap: str = "prefix") -> DataFrame:
    return E.query_metrics(all_candidates(spark, sf), truth(spark, sf), K, ("method",), ap)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("hits_at_k", _sql("SELECT method, query, k, n_truth, tp, fp, fn FROM hits"))
def _(spark, sf):
    hits = E.hits_at_k(all_candidates(spark, sf), truth(spark, sf), K, ("method",))
    return hits.select("method", "query", "k", "n_truth", "tp", "fp", "fn")


for _name, _measure in (("precision_at_k", "p"), ("recall_at_k", "r"), ("r_precision_at_k", "rp"), ("f1_at_k", "f1"),
                        ("average_precision_prefix", "ap")):
    @query(_name, _sql(f"SELECT method, query, k, round({_measure}, 6) AS {_measure} FROM measured"))
    def _(spark, sf, measure=_measure):
        return _rounded(_metrics(spark, sf).select("method", "query", "k", measure), measure)


@query("average_precision_standard", _sql("SELECT method, query, k, round(ap_standard, 6) AS ap FROM measured"))
def _(spark, sf):
    return _rounded(_metrics(spark, sf, "standard").select("method", "query", "k", "ap"), "ap")


SUMMARY = ("summary", "SELECT method, k, avg(p) AS precision, sum(tp) / sum(tp + fn) AS recall, avg(rp) AS r_precision, "
                      "avg(f1) AS f1, avg(ap) AS map FROM measured GROUP BY 1, 2")


@query("metrics_by_depth", _sql(
    "SELECT k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(r_precision, 6) AS r_precision, "
    "round(f1, 6) AS f1, round(map, 6) AS map FROM summary WHERE method = 'by_quantity'", SUMMARY))
def _(spark, sf):
    found = candidates(spark, sf, "by_quantity").drop("method")
    return _rounded(E.metrics_at_k(found, truth(spark, sf), K), "precision", "recall", "r_precision", "f1", "map")


@query("metrics_by_method", _sql(
    "SELECT method, k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(r_precision, 6) AS "
    "r_precision, round(f1, 6) AS f1, round(map, 6) AS map FROM summary", SUMMARY))
def _(spark, sf):
    return _rounded(E.metrics_at_k(all_candidates(spark, sf), truth(spark, sf), K, ("method",)),
                    "precision", "recall", "r_precision", "f1", "map")


@query("mean_precision_over_k", _sql(
    "SELECT method, round(avg(precision), 6) AS mean_precision FROM summary GROUP BY 1", SUMMARY))
def _(spark, sf):
    metrics = E.metrics_at_k(all_candidates(spark, sf), truth(spark, sf), K, ("method",))
    return _rounded(E.mean_precision(metrics, ("method",)), "mean_precision")


@query("query_report_wide", _sql("SELECT method, query, " + ", ".join(
    f"round(max(CASE WHEN k = {i} THEN {m} END), 6) AS \"{n}@{i}\"" for n, m in (("P", "p"), ("R", "r"), ("AP", "ap"))
    for i in range(1, K + 1)) + " FROM measured GROUP BY 1, 2"))
def _(spark, sf):
    report = E.query_report(_metrics(spark, sf), K, ("method",))
    return report.select("method", "query", *[F.round(f"`{c}`", 6).alias(c) for c in report.columns[2:]])


def _histogram(measure: str) -> list[tuple[str, str]]:
    return [
        ("xs", f"SELECT method, round({measure}, 9) AS x FROM measured"),
        ("ends", "SELECT method, min(x) AS lo, (max(x) - min(x)) / 10 AS width FROM xs GROUP BY 1"),
        ("slots", "SELECT *, unnest(range(0, 10)) AS bin FROM ends"),
        ("filled", "SELECT x.method, least(floor(round((x - lo) / width, 9)), 9) AS bin, count(*) AS n FROM xs x JOIN ends e "
                   "ON x.method = e.method GROUP BY 1, 2"),
    ]


for _name, _measure in (("recall_distribution", "r"), ("precision_distribution", "p")):
    @query(_name, _sql(
        "SELECT s.method, s.bin, round(lo + s.bin * width, 6) AS low, round(lo + s.bin * width + width, 6) AS high, "
        "coalesce(n, 0) AS n FROM slots s LEFT JOIN filled f ON s.method = f.method AND s.bin = f.bin",
        *_histogram(_measure)))
    def _(spark, sf, measure=_measure):
        return _rounded(E.distribution(_metrics(spark, sf), measure, by=("method",)), "low", "high")


@query("filter_evaluation", _sql(
    "SELECT method, round(sum(both_ / n_found) / (SELECT count(*) FROM n_truth), 6) AS precision, "
    "round(sum(both_ / n_truth) / (SELECT count(*) FROM n_truth), 6) AS recall FROM (SELECT method, query, count(*) AS "
    "n_found, sum(hit) AS both_ FROM marked GROUP BY 1, 2) JOIN n_truth USING (query) GROUP BY 1"))
def _(spark, sf):
    return _rounded(E.filter_metrics(all_candidates(spark, sf), truth(spark, sf), ("method",)), "precision", "recall")


# --- ground truths ---------------------------------------------------------------------------


@query("truth_lists_union", """
SELECT r_name AS query_table, n_name AS data_lake_table, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS position
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    pairs = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return group_truth(pairs.select(F.col("r_name").alias("query_table"), F.col("n_name").alias("data_lake_table")),
                       ["query_table"], ["data_lake_table"])


JOIN_TRUTH = """SELECT o_orderpriority AS benchmark, 'customer' || o_custkey AS query_table, o_orderstatus AS query_col,
'order' || l_orderkey AS cand_table, l_linestatus AS cand_col FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderpriority, 'customer' || o_custkey, o_orderstatus, 'customer' || o_custkey, o_orderstatus
FROM orders WHERE o_totalprice > 400000"""


def join_truth(spark, sf) -> DataFrame:
    """Customers and order states as query columns, order lines as candidates; large orders list themselves."""
    orders = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("benchmark"),
        F.concat(F.lit("customer"), F.col("o_custkey").cast("string")).alias("query_table"),
        F.col("o_orderstatus").alias("query_col"), "o_totalprice")
    lines = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.concat(F.lit("order"), F.col("l_orderkey").cast("string")).alias("cand_table"),
        F.col("l_linestatus").alias("cand_col"))
    found = orders.join(lines, "key").select("benchmark", "query_table", "query_col", "cand_table", "cand_col")
    listed = orders.filter(F.col("o_totalprice") > 400000).select(
        "benchmark", "query_table", "query_col", F.col("query_table").alias("cand_table"),
        F.col("query_col").alias("cand_col"))
    return found.unionByName(listed)


@query("truth_lists_join", f"""
SELECT query_table, query_col, cand_table, cand_col, row_number() OVER (PARTITION BY query_table, query_col
  ORDER BY cand_table, cand_col) AS position FROM (SELECT DISTINCT query_table, query_col, cand_table, cand_col
FROM ({JOIN_TRUTH}))""")
def _(spark, sf):
    pairs = join_truth(spark, sf).drop("benchmark").distinct()
    return group_truth(pairs, ["query_table", "query_col"], ["cand_table", "cand_col"])


SHAPE = [
    ("truth", JOIN_TRUTH),
    ("per_query", "SELECT benchmark, query_table, query_col, count(*) AS n, avg(CASE WHEN query_col = cand_col THEN 1.0 "
                  "ELSE 0.0 END) AS aligned, bool_or(query_table = cand_table AND query_col = cand_col) AS listed "
                  "FROM truth GROUP BY 1, 2, 3"),
]
SHAPE_FIELDS = {
    "truth_query_count": "count(*) AS queries_count",
    "truth_name_alignment": "round(avg(aligned), 6) AS alignment",
    "truth_mean_candidates": "round(avg(n), 6) AS avg_number_of_candidates",
    "truth_self_candidates": "count(*) FILTER (listed) AS query_in_candidates",
}


def _shape(spark, sf) -> DataFrame:
    return _rounded(truth_shape(join_truth(spark, sf)), "alignment", "avg_number_of_candidates")


def _shape_sql(fields: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in SHAPE) + f" SELECT benchmark, {fields} FROM per_query GROUP BY 1"


for _name, _field in SHAPE_FIELDS.items():
    @query(_name, _shape_sql(_field))
    def _(spark, sf, field=_field.rsplit(" ", 1)[1]):
        return _shape(spark, sf).select("benchmark", field)


@query("truth_summary", _shape_sql(", ".join(SHAPE_FIELDS.values())))
def _(spark, sf):
    return _shape(spark, sf)
