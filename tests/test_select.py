"""Row selection against pandas on a small lake with missing cells."""

import math
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakefind.operators import select as S

CELLS = "table_id string, row_idx long, col_idx int, col_name string, value string"
WIDE = {
    "a": pd.DataFrame({"n": ["10", "9", None, "2", "2", None], "t": ["red car", "blue", None, "Red x", "red car", "bus, car"],
                       "u": ["x", None, None, "y", "x", "z"], "v": ["1", None, None, "q", "x", "1"]}),
    "b": pd.DataFrame({"k": [str(i % 7) for i in range(40)], "t": [f"word{i % 3} tail{i}" for i in range(40)]}),
    "one": pd.DataFrame({"k": [None]}),
}


@pytest.fixture(params=[None, "8"], autouse=True)
def any_layout(spark, request):
    """Everything once with plain windows and once with hot groups split."""
    if request.param:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def cells(spark):
    rows = [(t, int(r), c, name, None if df.iat[r, c] is None else str(df.iat[r, c]))
            for t, df in WIDE.items() for r in range(len(df)) for c, name in enumerate(df.columns)]
    return spark.createDataFrame(rows, CELLS)


def wide(cells, table):
    got = cells.filter(F.col("table_id") == table).toPandas()
    if got.empty:
        return []
    table = got.pivot(index="row_idx", columns="col_idx", values="value").sort_index()
    assert list(table.index) == list(range(len(table)))
    return [[None if pd.isna(v) else v for v in row] for row in table.values.tolist()]


def rows_of(table):
    return [[None if v is None else v for v in row] for row in WIDE[table].values.tolist()]


def test_null_rows(cells):
    assert wide(S.drop_null_rows(cells), "a") == [rows_of("a")[i] for i in (0, 3, 4)]
    assert wide(S.drop_null_rows(cells, 2), "a") == [rows_of("a")[i] for i in (0, 1, 3, 4, 5)]
    assert wide(S.drop_null_rows(cells), "one") == []
    assert wide(S.order_by_nulls(cells), "a") == [rows_of("a")[i] for i in (0, 3, 4, 5, 1, 2)]
    assert wide(S.order_by_nulls(cells, 2), "a") == [rows_of("a")[i] for i in (0, 3)]


def tfidf(docs):
    tokens = [re.findall(r"\w{2,}", d.lower()) for d in docs]
    df = Counter(w for t in tokens for w in set(t))
    out = []
    for t in tokens:
        v = [n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in Counter(t).items()]
        out.append(sum(v) / math.sqrt(sum(x * x for x in v)) if v else 0.0)
    return out


@pytest.mark.parametrize("dropna", [False, True])
def test_tfidf(cells, dropna):
    docs = [" ".join(("nan" if v is None else v) for v in row if not (dropna and v is None)) for row in rows_of("a")]
    want = tfidf(docs)
    got = S.row_tfidf(cells, dropna).filter("table_id = 'a'").toPandas().set_index("row_idx")["score"].sort_index()
    assert list(got) == pytest.approx(want, abs=1e-6)
    order = sorted(range(len(docs)), key=lambda i: (-round(want[i], 6), i))
    assert wide(S.order_rows_by_tfidf(cells, dropna), "a") == [rows_of("a")[i] for i in order]


def test_value_sort_is_numeric_for_numbers(cells):
    got = wide(S.sort_columns_by_value(cells), "a")
    assert [r[0] for r in got] == ["2", "2", "9", "10", None, None]
    assert [r[1] for r in got] == ["Red x", "blue", "bus, car", "red car", "red car", None]


def test_idf_sort(cells):
    got = wide(S.sort_columns_by_idf(cells), "a")
    values = [v for row in rows_of("a") for v in row if v is not None]
    tokens = [set(re.findall(r"\w{2,}", v.lower())) for v in values]
    df = Counter(w for t in tokens for w in t)
    idf = {w: math.log((1 + len(values)) / (1 + n)) + 1 for w, n in df.items()}

    def score(v):
        return -1 if v is None else round(sum(idf.get(w, 0) for w in v.lower().split()) / len(v.split()), 6)

    for c in range(4):
        column = [row[c] for row in rows_of("a")]
        assert [row[c] for row in got] == sorted(column, key=score, reverse=True)


def test_distinct_columns(cells):
    got = wide(S.distinct_columns(cells), "a")
    for c in range(4):
        seen = list(dict.fromkeys(row[c] for row in rows_of("a")))
        assert [row[c] for row in got] == seen + [None] * (len(got) - len(seen))
    assert len(wide(S.distinct_columns(cells, 2), "a")) == 2


def test_samplers(cells):
    assert wide(S.head_rows(cells, 3), "b") == rows_of("b")[:3]
    assert wide(S.rate_sample(cells, 12), "b") == rows_of("b")[::3]
    assert wide(S.rate_sample(cells, 12), "a") == rows_of("a")
    sample = wide(S.sample_rows(cells, 6), "b")
    assert len(sample) == 6 and all(r in rows_of("b") for r in sample)
    assert sample == wide(S.sample_rows(cells.repartition(7), 6), "b")
    assert sorted(map(str, wide(S.sample_rows(cells, 6), "a"))) == sorted(map(str, rows_of("a")))
    assert sample != wide(S.sample_rows(cells, 6, seed=7), "b")
    assert sorted(wide(S.shuffle_rows(cells), "b")) == sorted(rows_of("b"))


def test_headers_and_caps(spark, cells):
    assert {r.col_name for r in S.blank_headers(cells).collect()} == {""}
    odd = spark.createDataFrame([("t", 0, 0, " Unnamed: 0", "v"), ("t", 0, 1, " keep ", "v")], CELLS)
    assert {r.col_name for r in S.blank_headers(odd, True).collect()} == {"", "keep"}
    big = spark.createDataFrame([("t", r, c, "h", "a b  c") for r in range(66) for c in range(66)], CELLS)
    small = S.cap(big, n_words=2)
    assert small.count() == 64 * 64 and {r.value for r in small.select("value").distinct().collect()} == {"a b"}


def test_by_name(cells):
    assert wide(S.select_rows(cells, "prioritize_non_null_rows", "head", 2), "a") == [rows_of("a")[i] for i in (0, 3)]
    assert wide(S.select_rows(cells, None, "rate", 12), "b") == rows_of("b")[::3]
    assert len(wide(S.select_rows(cells, "remove_rows_with_nulls", "sample", 4), "a")) == 4
    for bad in ({"process": "sort_col_indepedent"}, {"sampler": "tail"}):
        with pytest.raises(ValueError):
            S.select_rows(cells, **bad)


@pytest.mark.parametrize("block_texts", [1, 3, 65_536])
def test_scores_whatever_the_blocks(spark, cells, monkeypatch, block_texts):
    monkeypatch.setattr(S, "BLOCK_TEXTS", block_texts)
    again = cells.filter("table_id = 'b'").withColumn("table_id", F.lit("c")).withColumn("value", F.concat("value", F.lit(" tail9")))
    lake = cells.unionByName(again).unionByName(cells.limit(1).withColumn("table_id", F.lit(None).cast("string"))).repartition(7)
    got = {(r.table_id, r.row_idx): r.score for r in S.row_tfidf(lake).collect()}
    for table in ("a", "b", "one"):
        want = tfidf([" ".join("nan" if v is None else v for v in row) for row in rows_of(table)])
        assert [got[table, i] for i in range(len(want))] == pytest.approx(want, abs=1e-6)
    want = tfidf([" ".join(f"{v} tail9" for v in row) for row in rows_of("b")])
    assert [got["c", i] for i in range(len(want))] == pytest.approx(want, abs=1e-6)
    assert [score for (table, _), score in got.items() if table is None] == [0.0]
    assert wide(S.sort_columns_by_idf(lake), "a") == wide(S.sort_columns_by_idf(cells), "a")


def test_words_travel_once_per_block(spark):
    texts = spark.range(500).selectExpr("'t' AS table_id", "id", "concat('one two ', id % 5) AS text").coalesce(2)
    blocks = S._blocks(texts, "text")
    found = blocks.select("_block", "table_id", "text").mapInArrow(S._block_words, "_block long, table_id string, word string, n long")
    assert blocks.select("_block").distinct().count() == 2 and found.count() == 2 * 7
    assert {r.word: r.n for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()} == {
        "one": 500, "two": 500, **{str(i): 100 for i in range(5)}}
