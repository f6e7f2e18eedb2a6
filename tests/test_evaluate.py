"""Evaluation and profiling hand cases."""

import pytest
from pyspark.sql import functions as F

from lakefind.operators import evaluate as E
from lakefind.operators import profile as P

LIST = "query string, cand string, rank int"
CELLS = "table_id string, row_idx long, col_idx int, col_name string, value string"


@pytest.fixture
def lists(spark):
    found = [("q", "a", 1), ("q", "b", 2), ("q", "x", 3), ("q", "d", 4), ("q", "a", 5), ("lost", "a", 1)]
    truth = [("q", "a"), ("q", "b"), ("q", "d"), ("q", "e"), ("p", "a"), ("q", "a")]
    return spark.createDataFrame(found, LIST), spark.createDataFrame(truth, "query string, cand string")


def test_metrics(lists):
    found, truth = lists
    rows = {r.k: r for r in E.query_metrics(found, truth, 6).collect()}
    assert {r.query for r in rows.values()} == {"q"}
    assert [rows[k].tp for k in range(1, 7)] == [1, 2, 2, 3, 3, 3]
    assert [rows[k].fp for k in range(1, 7)] == [0, 0, 1, 1, 1, 1]
    assert [rows[k].fn for k in range(1, 7)] == [3, 2, 2, 1, 1, 1]
    assert rows[5].p == 3 / 5 and rows[5].r == 3 / 4 and rows[2].rp == 1.0 and rows[6].rp == 3 / 4
    assert rows[4].f1 == pytest.approx(0.75)
    assert [rows[k].ap for k in (1, 2, 4, 6)] == [0.25, 0.5, 0.5, 0.5]
    standard = {r.k: r.ap for r in E.query_metrics(found, truth, 6, ap="standard").collect()}
    assert standard[4] == pytest.approx((1 + 1 + 3 / 4) / 4) and standard[6] == standard[4]
    with pytest.raises(ValueError):
        E.query_metrics(found, truth, 3, ap="other")


def test_empty_list_counts_when_named(spark, lists):
    found, truth = lists
    queries = spark.createDataFrame([("q",), ("p",)], "query string")
    got = {r.k: r for r in E.metrics_at_k(found, truth, 2, queries=queries).collect()}
    assert got[1].precision == 0.5 and got[2].recall == pytest.approx(2 / 5)
    assert E.mean_precision(E.metrics_at_k(found, truth, 2)).first().mean_precision == 1.0


def test_report_and_distribution(lists):
    found, truth = lists
    metrics = E.query_metrics(found, truth, 4)
    report = E.query_report(metrics, 4)
    assert report.columns == ["query"] + [f"{m}@{k}" for m in ("P", "R", "AP") for k in range(1, 5)]
    assert report.first()["P@3"] == pytest.approx(2 / 3)
    bins = E.distribution(metrics, "r", 10).orderBy("bin").collect()
    assert [r.n for r in bins] == [1, 0, 0, 0, 0, 2, 0, 0, 0, 1]
    assert bins[0].low == 0.25 and bins[9].high == pytest.approx(0.75)
    flat = E.distribution(metrics.filter("k = 1"), "p", 10).orderBy("bin").collect()
    assert [r.n for r in flat] == [0, 0, 0, 0, 0, 1, 0, 0, 0, 0] and flat[0].low == 0.5
    assert sum(r.n for r in E.distribution(metrics, "r", step=2).collect()) == 2


def test_filter_metrics(spark, lists):
    _, truth = lists
    found = spark.createDataFrame([("q", "a"), ("q", "x"), ("lost", "a")], "query string, cand string")
    got = E.filter_metrics(found, truth).first()
    assert (got.precision, got.recall) == (0.25, 0.125)


def lake(spark):
    rows = {
        "a": [("n", ["1", "2", "3"]), ("f", ["1.5", None, "2"]), ("i", ["7", None, "8"]), ("s", ["x1", "yy", None]),
              ("b", ["True", "False", "True"]), ("e", [None, None, None])],
        "c": [("k", ["Ä the word", "word WORD-x"])],
    }
    return spark.createDataFrame(
        [(t, r, c, name, v) for t, cols in rows.items() for c, (name, vs) in enumerate(cols) for r, v in enumerate(vs)], CELLS)


def test_column_profile(spark):
    got = {r.col_name: r for r in P.profile_columns(lake(spark)).collect()}
    assert {n: r.dtype for n, r in got.items()} == {
        "n": "int", "f": "float", "i": "float", "s": "object", "b": "bool", "e": "float", "k": "object"}
    assert (got["f"].n_null, got["s"].n_digit, got["s"].numeric, got["i"].numeric) == (1, 1, False, True)
    shapes = {r.table_id: (r.n_rows, r.n_cols) for r in P.profile_tables(lake(spark)).collect()}
    assert shapes == {"a": (3, 6), "c": (2, 1)}


def test_lake_profile(spark):
    r = P.profile_lake(lake(spark).withColumn("lake", F.lit("l"))).first()
    assert (r.ttl_files, r.ttl_rows, r.ttl_cols, r.max_row, r.min_col, r.avg_row, r.nulls) == (2, 5, 7, 3, 1, 2.5, 6)
    assert (r.float64_cols, r.int64_cols, r.object_cols, r.cols_numeric, r.cols_non_numeric) == (3, 1, 2, 3, 4)


def test_query_profiles(spark):
    queries = spark.createDataFrame([("x", "a", "f"), ("x", "a", "s"), ("x", "a", "s")], "benchmark string, table_id string, col_name string")
    r = P.profile_query_columns(lake(spark), queries).first()
    assert (r.ttl_queries, r.nulls, r.cols_numeric, r.cols_non_numeric) == (2, 2, 1, 1)
    files = lake(spark).withColumn("table_id", F.concat("table_id", F.lit(".csv")))
    tables = spark.createDataFrame([("x", "a"), ("x", "c.csv")], "benchmark string, table_id string")
    r = P.profile_query_tables(files, tables).first()
    assert (r.ttl_queries, r.nulls, r.cols_numeric + r.cols_non_numeric) == (2, 6, 7)


def test_words_and_entities(spark):
    assert {r.word: r.cnt for r in P.word_counts(lake(spark)).collect()} == {"ä": 1, "word": 3, "x": 1}
    assert [r.word for r in P.word_counts(lake(spark), top=1).collect()] == ["word"]
    text = spark.createDataFrame([("t", 0, 0, "v", "On 2024-01-02 Anna Maria paid $5.20 to a@b.org, see http://x.org/a?b=1"),
                                  ("t", 1, 0, "v", None)], CELLS)
    got = {(r.text, r.label) for r in P.entity_counts(text).collect()}
    assert {("2024-01-02", "DATE"), ("Anna Maria", "NAME"), ("$5.20", "MONEY"), ("a@b.org", "EMAIL"),
            ("http://x.org/a?b=1", "URL")} <= got
    labels = {r.label: (r.cnt, r.n_texts) for r in P.entity_labels(P.entity_counts(text)).collect()}
    assert labels["EMAIL"] == (1, 1)


def test_truth_shape(spark):
    truth = spark.createDataFrame(
        [("m", "q", "k", "t1", "k"), ("m", "q", "k", "q", "k"), ("m", "q", "z", "t1", "y"), ("m", "q", "z", "t2", "z"),
         ("m", "q", "z", "t3", "w")], "benchmark string, query_table string, query_col string, cand_table string, cand_col string")
    r = P.truth_shape(truth).first()
    assert (r.queries_count, r.avg_number_of_candidates, r.query_in_candidates) == (2, 2.5, 1)
    assert r.alignment == pytest.approx((1 + 1 / 3) / 2)
