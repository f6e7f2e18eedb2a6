"""Sources and sinks: the given tables written as a delimited lake, sniffed, read back and stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.operators import union_search as U
from lakefind.operators.profile import column_types
from lakefind.plans.registry import query
from lakefind.plans.searching import JACCARD, TABLE_OUT, TABLE_RANK, table_out
from lakefind.plans.selection import OUT, TYPES, out
from lakefind.plans.views import LAKE, cells, clusters, col_vectors, read, with_views
from lakefind.session import work_dir
from lakefind.sources import lake as L
from lakefind.sources import tables as T

DELIMITERS = {"region": ";", "nation": "\t", "supplier": ",", "customer": ",", "part": ";", "orders": ","}
HEADERS = ("headers", "SELECT table_id, string_agg(col_name, '|' ORDER BY col_idx) AS header, arg_min(col_name, col_idx) AS first "
                      "FROM (SELECT DISTINCT table_id, col_idx, col_name FROM cells) GROUP BY 1")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/lakefind-{name}-{uuid.uuid4().hex}"


def write_lake(spark: SparkSession, sf: str, null_text: str = "") -> str:
    """The keyed tables as folders of CSV part files in key order, each with its own delimiter."""
    path = _folder(spark, "lake")
    for table, (key, columns) in LAKE.items():
        wide = read(spark, sf, table).orderBy(key).select(*[F.expr(e).alias(c) for c, e in columns.items()])
        wide.write.option("header", "true").option("sep", DELIMITERS[table]).option("nullValue", null_text).csv(f"{path}/{table}")
    return path


@query("lake_listing", with_views(["cells"], select="SELECT DISTINCT table_id, true AS has_bytes FROM cells"))
def _(spark, sf):
    files = L.list_lake(spark, write_lake(spark, sf), table_from="folder")
    return files.groupBy("table_id").agg((F.sum("n_bytes") > 0).alias("has_bytes"))


@query("lake_listing_all_files", with_views(["cells"], select=(
    "SELECT table_id, count(*) > 0 AS is_table FROM cells GROUP BY 1 UNION ALL SELECT 'notes', true FROM region WHERE r_regionkey = 0")))
def _(spark, sf):
    path = write_lake(spark, sf)
    read(spark, sf, "region").select("r_name").write.text(f"{path}/notes")  # not delimited files
    files = L.list_lake(spark, path, csv_only=False, table_from="folder").filter(~F.col("path").contains("_SUCCESS"))
    return files.groupBy("table_id").agg((F.count(F.lit(1)) > 0).alias("is_table"))


@query("sniffed_lake", with_views(["cells"], HEADERS, select=(
    "SELECT table_id, 'UTF-8' AS encoding, CASE " + " ".join(f"WHEN table_id = '{t}' THEN '{d}'" for t, d in DELIMITERS.items())
    + " END AS delimiter, header FROM headers")))
def _(spark, sf):
    files = L.sniff_lake(spark, write_lake(spark, sf), table_from="folder")
    return files.select("table_id", "encoding", "delimiter", F.array_join("header", "|").alias("header")).distinct()


FIRST_LINES = """(SELECT 'doc' AS kind, doc_id AS id, string_split(text, chr(10))[1] AS line FROM documents UNION ALL
SELECT 'page', page_id, string_split(html, chr(10))[1] FROM pages UNION ALL SELECT 'event', event_id, props FROM events)"""


def first_lines(spark, sf) -> DataFrame:
    line = lambda c: F.substring_index(c, "\n", 1)
    docs = read(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), line("text").alias("line"))
    pages = read(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), line("html").alias("line"))
    events = read(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("line"))
    return docs.unionByName(pages).unionByName(events)


def _sniff_sql(precedence: str) -> str:
    *tried, last = L.PRECEDENCES[precedence]
    whens = " ".join(f"WHEN contains(line, '{d}') THEN '{d}'" for d in tried)
    fallback = "NULL" if precedence == "profile" else f"'{last}'"
    return f"SELECT kind, id, CASE {whens} ELSE {fallback} END AS delimiter FROM {FIRST_LINES}"


for _precedence in L.PRECEDENCES:
    @query(f"sniff_delimiter_{_precedence}", _sniff_sql(_precedence))
    def _(spark, sf, precedence=_precedence):
        return first_lines(spark, sf).select("kind", "id", L.sniff_delimiter(F.col("line"), precedence).alias("delimiter"))


@query("read_csv_lake", with_views(["cells"], select=f"SELECT {OUT} FROM cells"))
def _(spark, sf):
    return out(L.read_lake(spark, write_lake(spark, sf), table_from="folder"))


@query("read_lake_by_manifest", with_views(["cells"], select=f"SELECT {OUT} FROM cells"))
def _(spark, sf):
    path, at = write_lake(spark, sf, null_text="<none>"), _folder(spark, "manifest")
    entries = [(t, r"\t" if d == "\t" else d, "FALSE", "csv", "<none>", "", "TRUE", "") for t, d in DELIMITERS.items()]
    spark.createDataFrame(entries, "filename string, delimiter string, multiline string, file string, nullVal string, "
                          "file_size string, ignoreTrailing string, source string").write.option("header", "true").csv(at)
    return out(L.read_lake(spark, path, L.read_manifest(spark, at), table_from="folder"))


@query("catalog_column_types", with_views(["cells"], (TYPES[0], TYPES[1].format("cells")), select=(
    "SELECT table_id || '.csv' AS table_id, CAST(col_idx AS BIGINT) AS col_idx, dtype FROM types")))
def _(spark, sf):
    at = _folder(spark, "types")
    lake = cells(spark, sf)
    pairs = F.sort_array(F.collect_list(F.struct("col_idx", "dtype")))  # as many as a table has columns
    column_types(lake).groupBy("table_id").agg(pairs.alias("column_types")).write.json(at)
    stored = spark.read.schema("table_id string, column_types array<struct<col_idx: bigint, dtype: string>>").json(at)
    tables = lake.select(F.concat("table_id", F.lit(".csv")).alias("table_id")).distinct()
    return T.catalog_lookup(tables, stored, "column_types").select("table_id", F.inline("column_types"))


@query("catalog_lookup", with_views(["cells"], HEADERS, select=(
    "SELECT table_id || '.csv' AS table_id, first AS primary_key FROM headers")))
def _(spark, sf):
    at = _folder(spark, "catalog")
    lake = cells(spark, sf)
    catalog = lake.groupBy("table_id").agg(F.min_by("col_name", "col_idx").alias("column"))
    catalog.select("table_id", F.struct("column").alias("primary_key")).write.json(at)
    stored = spark.read.schema("table_id string, primary_key struct<column: string>").json(at)
    tables = lake.select(F.concat("table_id", F.lit(".csv")).alias("table_id")).distinct()
    known = stored.select("table_id", F.col("primary_key.column").alias("primary_key"))
    return T.catalog_lookup(tables, known, "primary_key")


@query("read_vector_shards", with_views(["vectors"], select=(
    "SELECT CAST(col_idx % 6 + 1 AS BIGINT) AS shard, table_id, CAST(col_idx AS BIGINT) AS col_idx, "
    "round(list_sum(vec), 4) AS x_sum FROM col_vectors")))
def _(spark, sf):
    at = _folder(spark, "vectors")
    T.write(col_vectors(spark, sf).withColumn("shard", F.expr("col_idx % 6 + 1")), at, partition_by=["shard"])
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return T.read_vectors(spark, at).select(
        F.col("shard").cast("long").alias("shard"), "table_id", F.col("col_idx").cast("long"),
        F.round(total, 4).alias("x_sum"))


@query("read_table_records", with_views(["cells"], select=f"SELECT {OUT} FROM cells"))
def _(spark, sf):
    at = _folder(spark, "records")
    T.to_table_record(cells(spark, sf)).select("record").write.text(at)
    return out(T.read_table_json(spark, at))


@query("table_records", with_views(
    ["cells"],
    ("rows_", "SELECT table_id, row_idx, list(value ORDER BY col_idx) AS r, list({'name': col_name} ORDER BY col_idx) AS h "
              "FROM cells GROUP BY 1, 2"),
    ("tables_", "SELECT table_id, row_idx // 1000 AS part, min(row_idx) AS first_row, arg_min(h, row_idx) AS header, "
                "list(r ORDER BY row_idx) AS data FROM rows_ GROUP BY 1, 2"),
    select="SELECT table_id, part, CAST(to_json({'id': table_id, 'first_row': first_row, 'table': {'caption': NULL, 'header': header, 'data': data}}) AS "
           "VARCHAR) AS record FROM tables_"))
def _(spark, sf):
    return T.to_table_record(cells(spark, sf))


@query("column_map", with_views(["cells"], select=(
    "SELECT DISTINCT table_id, 0 AS vector_idx, 'table' AS name, 'table_embedding' AS type FROM cells UNION ALL "
    "SELECT DISTINCT table_id, CAST(col_idx AS BIGINT) + 1, col_name, 'column_embedding' FROM cells")))
def _(spark, sf):
    return T.column_map(cells(spark, sf))


CANDIDATES = [*JACCARD, ("ranked", f"SELECT *, {TABLE_RANK} FROM jaccard")]


def _sink(name: str, fmt: str):
    @query(name, with_views(["clusters"], *CANDIDATES, select=f"SELECT {TABLE_OUT} FROM ranked WHERE rank <= 10"))
    def _(spark, sf):
        at = _folder(spark, "candidates")
        groups = clusters(spark, sf)
        found = table_out(U.union_by_cluster(groups.select("table_id"), groups, 10))
        T.write(found, at, fmt)
        reader = spark.read.schema(found.schema)
        return (reader.option("header", "true").csv(at) if fmt == "csv" else reader.format(fmt).load(at))


for _fmt in T.FORMATS:
    _sink(f"candidates_as_{_fmt}", _fmt)
