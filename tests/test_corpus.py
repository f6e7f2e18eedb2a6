"""Corpus jobs, hypergraphs and hashed vectors on hand cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefind.operators import corpus as C
from lakefind.operators import hypergraph as H
from lakefind.operators import profile as P
from lakefind.operators import select as S

CELLS = "table_id string, row_idx long, col_idx int, col_name string, value string"


def cells(spark, rows, names=("a", "b"), table="t"):
    return spark.createDataFrame(
        [(table, r, c, names[c], v) for r, row in enumerate(rows) for c, v in enumerate(row)], CELLS)


def test_drop_header_rows(spark):
    lake = cells(spark, [["city", "b "], ["the city", "b"], ["Rome", "z"], ["city", "b"]], ("city", "b"))
    got = {(r.row_idx, r.value) for r in C.drop_header_rows(lake).filter("col_idx = 0").collect()}
    assert got == {(0, "the city"), (1, "Rome"), (2, "city")}
    assert C.drop_header_rows(cells(spark, [["idaho", "b"]], ("id", "b"))).count() == 2
    assert C.drop_header_rows(cells(spark, [["a", "b"]], ("a", "b"))).count() == 0
    assert C.drop_header_rows(cells(spark, [[None, "b"], ["1", "2"]], ("", "b"))).count() == 2
    assert C.drop_header_rows(cells(spark, [[None, "x"], ["a", "y"]])).count() == 4


def test_linear_text_round_trip(spark):
    lake = cells(spark, [["1", None], ["naïve|x", "td y"]], ("h", ""))
    text = C.linearize(lake).first().text
    assert text == "<caption> [TAB] <header> h | [HEAD] <row> 1 | [CELL] <row> naive x | y"
    back = C.parse_text(C.linearize(lake.withColumn("caption", F.lit("My table")))).collect()
    assert {(r.caption, r.row_idx, r.col_idx, r.col_name, r.value) for r in back} == {
        ("My table", 0, 0, "h", "1"), ("My table", 0, 1, "[HEAD]", "[CELL]"),
        ("My table", 1, 0, "h", "naive x"), ("My table", 1, 1, "[HEAD]", "y")}
    bad = spark.createDataFrame([("t", 0, "<caption> c <header> a | b <row> 1 | 2 <row> 3")], "table_id string, part long, text string")
    assert C.parse_text(bad).count() == 0


def test_lexicon(spark):
    lake = cells(spark, [["X", "y"], ["x", None], ["z", " "]])
    assert {r.text: r.cnt for r in C.lexicon(lake).collect()} == {"x": 2, "y": 1, "z": 1, "[CELL]": 2}
    assert {r.text: r.cnt for r in C.lexicon(lake, "header").collect()} == {"a": 1, "b": 1}
    top = C.top_lexicon(C.lexicon(lake), 0.5).orderBy("rank").collect()
    assert [(r.text, r.cnt, round(r.p, 6)) for r in top] == [("x", 2, 0.666667), ("y", 1, 0.333333)]
    with pytest.raises(ValueError):
        C.lexicon(lake, "caption")


def test_corruption(spark):
    rows = [[f"v{r}" if r % 5 else None, f"w{r}"] for r in range(50)]
    lake = cells(spark, rows)
    masked = C.corrupt_mask(lake, 0.2).collect()
    assert sum(r.label_cell for r in masked) <= 20 and sum(r.label_cell for r in masked) > 10
    for r in masked:
        was = rows[r.row_idx][r.col_idx]
        assert r.value == ("[CELL]" if r.label_cell else was) and not (r.label_cell and was is None)
    assert [tuple(r) for r in sorted(masked)] == sorted(tuple(r) for r in C.corrupt_mask(lake.repartition(5), 0.2).collect())
    lex = spark.createDataFrame([("common", 9000), ("rare", 1000)], "text string, cnt long")
    heads = spark.createDataFrame([("H", 1)], "text string, cnt long")
    many = cells(spark, [[f"v{r}", f"w{r}"] for r in range(1000)])
    drawn = C.corrupt_replace(many, lex, heads, 0.5).collect()
    counts = Counter(r.value for r in drawn if r.label_cell)
    assert set(counts) == {"common", "rare"} and sum(counts.values()) == 1000
    assert 0.85 < counts["common"] / 1000 < 0.95
    assert {r.col_name for r in drawn if r.label_head} == {"H"} and len(drawn) == 2000


def test_draw_hits_every_position(spark):
    lex = spark.createDataFrame([(f"w{i}", 1 + i % 3) for i in range(100)], "text string, cnt long")
    items = spark.range(5000)
    drawn = C.draw(items, lex, F.md5(F.col("id").cast("string")), "text")
    assert drawn.count() == 5000 and drawn.select("text").distinct().count() == 100


def test_split_and_views(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("id"))
    parts = {r.part: r["count"] for r in C.split(df, ["id"], 0.1).groupBy("part").count().collect()}
    assert parts == {"valid": 10, "train": 93}
    valid = lambda d: sorted(r.id for r in C.split(d, ["id"], 0.1).filter("part = 'valid'").collect())
    assert valid(df) == valid(df.repartition(9))
    graph = H.incidence(H.numbered_cells(cells(spark, [["1", "2"]] * 10)))
    views = C.edge_views(graph, 0.3).toPandas()
    assert len(views) == 60 and views["view_1"].sum() == views["view_2"].sum() == 42
    assert (views["view_1"] != views["view_2"]).any()


def test_hypergraph_numbers(spark):
    numbered = H.numbered_cells(cells(spark, [["1", ""], [None, "4"]]))
    links = {(r.node_id, r.edge_id) for r in H.incidence(numbered).collect()}
    assert links == {(n, e) for n, (r, c) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)]) for e in (0, 1 + c, 3 + r)}
    assert {r.node_id: r.text for r in H.nodes(numbered).collect()} == {0: "1", 1: "[CELL]", 2: "[CELL]", 3: "4"}
    assert {(r.edge_id, r.kind, r.text) for r in H.hyperedges(numbered).collect()} == {
        (0, "table", "[TAB]"), (1, "column", "a"), (2, "column", "b"), (3, "row", "[ROW]"), (4, "row", "[ROW]")}


def token_vector(text, dim):
    tokens = [text] if text.startswith("[") else re.findall(r"\w+", re.sub(
        r"\d+", lambda m: f"{m.group().rstrip('0')} scinotexp {len(m.group()) - 1}", text.lower()))
    v = np.zeros(dim)
    for t in tokens:
        h = hashlib.md5(t.encode()).hexdigest()
        v[int(h[:8], 16) % dim] += (1 if h[8] < "8" else -1) / len(tokens)
    return v


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_column_vectors(spark, rounds):
    data, names, dim = [["red 12", "x"], ["blue", None], ["red", "y z"]], ("color", "b"), 16
    edges = [token_vector("[TAB]", dim), *(token_vector(n, dim) for n in names), *(token_vector("[ROW]", dim) for _ in data)]
    nodes = [token_vector(v or "[CELL]", dim) for row in data for v in row]
    links = [(i, e) for i in range(6) for e in (0, 1 + i % 2, 3 + i // 2)]
    for _ in range(rounds):
        edges = [(e + np.mean([nodes[i] for i, j in links if j == k], axis=0)) / 2 for k, e in enumerate(edges)]
        nodes = [np.mean([edges[j] for k, j in links if k == i], axis=0) for i in range(6)]
    got = H.column_vectors(cells(spark, data, names), dim, rounds).orderBy("col_idx").collect()
    assert [r.col_name for r in got] == ["color", "b"]
    assert np.allclose([r.vec for r in got], edges[1:3])


def test_wide_tables_give_real_columns_only(spark):
    lake = spark.createDataFrame([("t", r, c, f"h{c}", "v") for r in range(2) for c in range(70)], CELLS)
    assert H.column_vectors(lake, 8).count() == 70


def test_processed_counts(spark):
    lake = cells(spark, [["1", "2"]]).unionByName(cells(spark, [["1", None]], table="u"))
    got = H.processed_counts(lake, lake.filter("table_id = 't'")).first()
    assert (got.n_processed, got.n_skipped) == (1, 1)


def test_steps_by_name(spark):
    done = C.normalize_cells(cells(spark, [["100\x7f", None]]), ["strip_delete", "scientific_numbers", "fill_missing"])
    assert sorted(r.value for r in done.collect()) == ["1 scinotexp 2", "[CELL]"]
    with pytest.raises(ValueError):
        C.normalize_cells(cells(spark, [["1", "2"]]), ["stem"])


@pytest.mark.parametrize("operator", [
    lambda lake: H.hyperedges(H.numbered_cells(lake)),
    lambda lake: H.hashed_components(H.nodes(H.numbered_cells(lake)), ["table_id", "node_id"]),
    lambda lake: C.corrupt_mask(lake, 0.3),
    lambda lake: C.parse_text(C.linearize(lake)),
    lambda lake: P.entity_counts(lake),
    lambda lake: S.rate_sample(lake),
    lambda lake: S.row_tfidf(lake),
    lambda lake: S.cell_idf(lake),
])
def test_no_task_gets_all_rows_of_a_table(spark, operator):
    """Nothing is dealt by table (or column) alone, which puts the largest table of a lake into one task."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = operator(cells(spark, [["1", "x"]] * 300)).select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    dealt = re.findall(r"(?<!Broadcast)Exchange hashpartitioning\(([^)]*)\)", plan)
    for keys in dealt:
        names = {k.split("#")[0].strip() for k in keys.split(",") if "#" in k}
        assert not names <= {"table_id", "col_idx"}, keys


def test_two_rounds_of_ragged_and_repeated_rows(spark):
    rows = [("t", 0, 0, "a", "x"), ("t", 0, 1, "b", "y"), ("t", 1, 1, "b", "z"), ("t", 2, 0, "a", "x"), ("t", 2, 0, "a", "w")]
    nodes = [(r, c, token_vector(v, 16)) for _, r, c, _, v in rows]
    edges = {0: token_vector("[TAB]", 16), 1: token_vector("a", 16), 2: token_vector("b", 16),
             **{3 + r: token_vector("[ROW]", 16) for r in range(3)}}
    for _ in range(2):
        mean = lambda k: np.mean([v for r, c, v in nodes if k in (0, 1 + c, 3 + r)], axis=0)
        edges = {k: (e + mean(k)) / 2 for k, e in edges.items()}
        nodes = [(r, c, (edges[0] + edges[1 + c] + edges[3 + r]) / 3) for r, c, _ in nodes]
    got = H.column_vectors(spark.createDataFrame(rows, CELLS), 16, 2).orderBy("col_idx").collect()
    # a place held by two cells is one node with the sum of their vectors and counts as two
    assert len(got) == 2 and np.isfinite([r.vec for r in got]).all()
    assert np.allclose(got[1].vec, edges[2])
