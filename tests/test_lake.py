"""Reading delimited files of all kinds, manifests, catalogs, records and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from lakefind.sources import lake as L
from lakefind.sources import tables as T


def grid(cells, table):
    out = {}
    for r in cells.filter(F.col("table_id") == table).collect():
        out.setdefault(r.row_idx, {})[r.col_idx] = (r.col_name, r.value)
    return [[out[i][j][1] for j in sorted(out[i])] for i in sorted(out)], [out[0][j][0] for j in sorted(out[0])] if out else []


@pytest.fixture
def lake(tmp_path):
    (tmp_path / "comma.csv").write_text('a,b,c\n1,"x, y",NA\n2,z\n3,too,many,fields\n4,,w\n', encoding="utf-8")
    (tmp_path / "semi.CSV").write_text("name;a,b\nété;1\nnull;2\n", encoding="utf-8")
    (tmp_path / "tab.csv").write_text("﻿k\t\tk\n1\t2\t3\n", encoding="utf-8")
    (tmp_path / "latin.csv").write_bytes("stadt;ort\nKöln;é\nMünchen;ß\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_text("only,header\n")
    (tmp_path / "notes.txt").write_text("not a table\n")
    return str(tmp_path)


def test_listing(spark, lake):
    names = {r.table_id for r in L.list_lake(spark, lake).collect()}
    assert names == {"comma.csv", "semi.CSV", "tab.csv", "latin.csv", "empty.csv"}
    assert "notes.txt" in {r.table_id for r in L.list_lake(spark, lake, csv_only=False).collect()}


def test_sniffing(spark, lake):
    got = {r.table_id: (r.encoding, r.delimiter, r.header) for r in L.sniff_lake(spark, lake).collect()}
    assert got["semi.CSV"] == ("UTF-8", ";", ["name", "a,b"])
    assert got["latin.csv"] == ("ISO-8859-1", ";", ["stadt", "ort"])
    assert got["tab.csv"] == ("UTF-8", "\t", ["k", "Unnamed: 1", "k"])


def test_reading(spark, lake):
    cells = L.read_lake(spark, lake).cache()
    assert grid(cells, "comma.csv") == ([["1", "x, y", None], ["2", "z", None], ["4", None, "w"]], ["a", "b", "c"])
    assert grid(cells, "semi.CSV")[0] == [["été", "1"], [None, "2"]]
    assert grid(cells, "latin.csv")[0] == [["Köln", "é"], ["München", "ß"]]
    assert grid(cells, "tab.csv") == ([["1", "2", "3"]], ["k", "Unnamed: 1", "k"])
    assert grid(cells, "empty.csv") == ([], [])


def test_names_and_quoted_line_breaks(spark, tmp_path):
    for name in ("my file.csv", "x[1].csv", "50%.csv", "a+b.csv"):
        (tmp_path / name).write_text(f'a,b\n1,{name}\n')
    (tmp_path / "breaks.csv").write_text(
        'i,t\n1,"x\n\ny, ""z"""\n2,5" pipe\n3,"one, line"\n4,"\nlast"\n5,end\n')
    cells = L.read_lake(spark, str(tmp_path)).cache()
    for name in ("my file.csv", "x[1].csv", "50%.csv", "a+b.csv"):
        assert grid(cells, name) == ([["1", name]], ["a", "b"])
    listed = {r.table_id for r in L.list_lake(spark, str(tmp_path)).collect()}
    assert listed == {r.table_id for r in cells.select("table_id").distinct().collect()}
    assert grid(cells, "breaks.csv")[0] == [["1", 'x\n\ny, "z"'], ["2", '5" pipe'], ["3", "one, line"], ["4", "\nlast"], ["5", "end"]]


def test_quoted_line_breaks_across_splits(spark, tmp_path):
    (tmp_path / "long.csv").write_text("i,t\n" + "".join(f'{i},"{"x" * (i % 50)}\n{i}"\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        cells = L.read_lake(spark, str(tmp_path)).filter("col_idx = 1")
        assert {r.row_idx: r.value for r in cells.collect()} == {i: f"{'x' * (i % 50)}\n{i}" for i in range(3000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_splits_keep_the_row_order(spark, tmp_path):
    (tmp_path / "long.csv").write_text("i,t\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        cells = L.read_lake(spark, str(tmp_path)).filter("col_idx = 0")
        assert {r.row_idx: r.value for r in cells.collect()} == {i: str(i) for i in range(5000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_manifest(spark, tmp_path):
    (tmp_path / "lake").mkdir()
    (tmp_path / "lake" / "a.csv").write_text('x\ty,z\n1\tNULL\n"two\nlines"\tq  \n')
    (tmp_path / "manifest.csv").write_text(
        '﻿filename,delimiter,multiline,file,nullVal,file_size,ignoreTrailing,source\n'
        'a.csv,\\t,TRUE,csv,NULL,1kb,TRUE,here\nb.csv,",",FALSE,csv,"""""",1kb,FALSE,there\n')
    manifest = L.read_manifest(spark, str(tmp_path / "manifest.csv"))
    rows = {r.table_id: r for r in manifest.collect()}
    assert rows["a.csv"].m_delimiter == "\t" and rows["a.csv"].null_text == "NULL" and rows["b.csv"].null_text is None
    cells = L.read_lake(spark, str(tmp_path / "lake"), manifest)
    assert grid(cells, "a.csv") == ([["1", None], ["two\nlines", "q"]], ["x", "y,z"])


def test_catalog(spark, tmp_path):
    for name, key in (("a", "id"), ("b", "code")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"primary_key": {"column": key}}, indent=1))
    catalog = T.read_catalog(spark, str(tmp_path), "primary_key struct<column: string>")
    known = catalog.select("table_id", F.col("primary_key.column").alias("key"))
    tables = spark.createDataFrame([("a.csv",), ("b.csv",), ("c.csv",)], "table_id string")
    assert {r.table_id: r.key for r in T.catalog_lookup(tables, known, "key").collect()} == {
        "a.csv": "id", "b.csv": "code", "c.csv": None}


CELLS = "table_id string, row_idx long, col_idx int, col_name string, value string"


def test_record_round_trip(spark, tmp_path):
    rows = [("t", r, c, [" h1 ", "Unnamed: 1"][c], v) for r in range(3) for c, v in enumerate([f"v{r}", None])]
    cells = spark.createDataFrame(rows, CELLS)
    record = json.loads(T.to_table_record(cells, 2, blank_unnamed=True).orderBy("part").first().record)
    assert record == {"id": "t", "first_row": 0, "table": {"caption": None, "header": [{"name": "h1"}, {"name": ""}],
                                           "data": [["v0", None], ["v1", None]]}}
    T.to_table_record(cells, 2).select("record").write.text(str(tmp_path / "r"))
    back = T.read_table_json(spark, str(tmp_path / "r"))
    assert {(r.row_idx, r.value) for r in back.filter("col_idx = 0").collect()} == {(k, f"v{k}") for k in range(3)}
    assert back.count() == 6 and back.filter("caption IS NOT NULL").count() == 0


def test_column_map_and_truth_lists(spark):
    cells = spark.createDataFrame([("t", 0, 0, "a", "1"), ("t", 0, 1, "b", "2")], CELLS)
    assert sorted((r.vector_idx, r.name) for r in T.column_map(cells).collect()) == [(0, "table"), (1, "a"), (2, "b")]
    pairs = spark.createDataFrame([("q", "y"), ("q", "x"), ("p", "z")], "q string, c string")
    assert sorted((r.q, r.position, r.c) for r in T.group_truth(pairs, ["q"], ["c"]).collect()) == [
        ("p", 1, "z"), ("q", 1, "x"), ("q", 2, "y")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "t string, n int")
    T.write(df, str(tmp_path / "p"), partition_by=["n"])
    assert T.read_vectors(spark, str(tmp_path / "p")).count() == 2
    with pytest.raises(ValueError):
        T.write(df, str(tmp_path / "x"), "pickle")
