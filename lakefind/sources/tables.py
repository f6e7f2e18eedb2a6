"""Catalogs, vectors, ground truth, records and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.functions.ranking import rank_within

RECORD_SCHEMA = (
    "id string, first_row bigint, table struct<caption: string, header: array<struct<name: string>>, data: array<array<string>>>"
)
FORMATS = ("parquet", "csv", "json")


def group_truth(pairs: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Ground-truth pairs as one ordered candidate list per query.

    The list is kept flat, ``(key, position, value)``, so that a query with
    very many candidates is never one row or one task.
    """
    pairs = pairs.select(*key, *value)
    return rank_within(pairs, key, [F.col(v) for v in value], "position")


def catalog_lookup(tables: DataFrame, catalog: DataFrame, field: str) -> DataFrame:
    """One catalog field per table; the catalog is keyed by the file name without its suffix."""
    key = F.substring_index("table_id", ".", 1)
    known = catalog.select(F.col("table_id").alias("_key"), F.col(field))
    return tables.withColumn("_key", key).join(known, "_key", "left").drop("_key")


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per table; ``table_id`` is the file name without its suffix."""
    return (
        spark.read.schema(schema).option("multiLine", "true").json(path)
        .select(F.substring_index(F.col("_metadata.file_name"), ".", 1).alias("table_id"), "*")
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Column vectors of all shards; ``shard=...`` folders become a partition column."""
    return spark.read.parquet(path)


def read_table_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines corpus, one table or part of a table per line, as ``cells`` with the caption kept."""
    raw = spark.read.schema(RECORD_SCHEMA).json(path)
    rows = raw.select("id", "first_row", "table.caption", "table.header", F.posexplode("table.data").alias("at", "row"))
    rows = rows.withColumn("row_idx", F.coalesce("first_row", F.lit(0)) + F.col("at"))
    cells = rows.select("id", "caption", "row_idx", F.posexplode(F.arrays_zip("header", "row")).alias("col_idx", "c"))
    return cells.select(
        F.col("id").alias("table_id"), "caption", F.col("row_idx").cast("long"), "col_idx",
        F.col("c.header.name").alias("col_name"), F.col("c.row").alias("value"))


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
          mode: str = "errorifexists") -> None:
    """Vectors, candidates, clusters or summaries as Parquet, CSV or JSON."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def column_map(cells: DataFrame) -> DataFrame:
    """``0 -> table``, ``i -> header_i``: what each vector of a table stands for."""
    headers = cells.groupBy("table_id", "col_idx").agg(F.first("col_name").alias("name"))
    columns = headers.select("table_id", (F.col("col_idx") + 1).cast("long").alias("vector_idx"), "name",
                             F.lit("column_embedding").alias("type"))
    tables = headers.select("table_id").distinct().select(
        "table_id", F.lit(0).cast("long").alias("vector_idx"), F.lit("table").alias("name"),
        F.lit("table_embedding").alias("type"))
    return tables.unionByName(columns)


def to_table_record(cells: DataFrame, part_rows: int = 1000, blank_unnamed: bool = False) -> DataFrame:
    """``(table_id, part, record)``: whole tables as nested JSON records of at most ``part_rows`` rows.

    A record carries its first row, so that ``read_table_json`` puts the parts
    together again.  A caller that wants only some rows selects them before (``select.head_rows``).
    """
    name = F.trim("col_name")
    if blank_unnamed:
        name = F.when(F.contains(F.lower(name), F.lit("unnamed")), F.lit("")).otherwise(name)
    ordered = F.sort_array(F.collect_list(F.struct("col_idx", "name", "value")))
    rows = cells.withColumn("name", name).groupBy("table_id", "row_idx").agg(ordered.alias("cells"))
    rows = rows.select(
        "table_id", F.floor(F.col("row_idx") / part_rows).alias("part"),
        F.struct("row_idx", F.transform("cells", lambda c: c["value"]).alias("row")).alias("item"),
        F.transform("cells", lambda c: F.struct(c["name"].alias("name"))).alias("header"))
    parts = rows.groupBy("table_id", "part").agg(
        F.min_by("header", F.col("item.row_idx")).alias("header"), F.sort_array(F.collect_list("item")).alias("items"))
    record = F.struct(
        F.col("table_id").alias("id"), F.col("items")[0]["row_idx"].alias("first_row"),
        F.struct(F.lit(None).cast("string").alias("caption"), "header",
                 F.transform("items", lambda i: i["row"]).alias("data")).alias("table"))
    return parts.select("table_id", "part", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))
