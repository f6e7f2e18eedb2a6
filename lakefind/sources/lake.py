"""Reading a directory of heterogeneous delimited files into ``cells``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakefind.functions.ranking import running
from lakefind.session import materialize

CSV_FILES = "*.[cC][sS][vV]"

# Delimiter precedences seen in the wild ("" = one column only).
PRECEDENCES = {
    "ingest": [";", "\t", ","],
    "search": [";", "\t", "|", ","],
    "profile": [";", ",", "\t", ""],
}

# Field texts that count as a missing cell.
MISSING_FIELDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def list_lake(spark: SparkSession, path: str, csv_only: bool = True, table_from: str = "file") -> DataFrame:
    """The files of a lake: ``(table_id, path, n_bytes)``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if csv_only:
        reader = reader.option("pathGlobFilter", CSV_FILES)
    files = reader.load(path).select(
        _table_name(F.col("path"), table_from).alias("table_id"), "path", F.col("length").alias("n_bytes"))
    return files if csv_only else files.filter(~F.col("path").endswith("/.DS_Store"))


def sniff_delimiter(first_line: Column, precedence: str = "ingest") -> Column:
    """The first delimiter of the precedence that occurs in the line; the last one by default."""
    *tried, fallback = PRECEDENCES[precedence]
    choice = F.lit(fallback)
    if precedence == "profile":
        choice = F.lit(None).cast("string")
    for delimiter in reversed(tried):
        choice = F.when(F.contains(first_line, F.lit(delimiter)), F.lit(delimiter)).otherwise(choice)
    return choice


def split_fields(line: Column, delimiter: Column) -> Column:
    """Fields of one delimited line, quotes removed."""
    literal = F.when(delimiter == "|", F.lit(r"\|")).otherwise(delimiter)
    # Every field is found with the delimiter before it, so the line gets one in front.
    pattern = F.concat(literal, F.lit('("(?:[^"]|"")*"|[^'), delimiter, F.lit("]*)"))
    fields = F.regexp_extract_all(F.concat(delimiter, line), pattern, F.lit(1))
    return F.transform(
        fields,
        lambda f: F.when(f.rlike('(?s)^".*"$'), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"')))
        .otherwise(f),
    )


def _decoded(file_path: Column) -> Column:
    """The path as it is on disk; file metadata give it URL-encoded, except for plus signs."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def _table_name(path: Column, table_from: str) -> Column:
    """The file name, or the name of its folder for tables written as part files (``key=name`` is cut to name)."""
    if table_from not in ("file", "folder"):
        raise ValueError(f"unknown table naming: {table_from}")
    folder = F.element_at(F.split(path, "/"), -2)
    return F.element_at(F.split(path, "/"), -1) if table_from == "file" else F.element_at(F.split(folder, "="), -1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the lake's files: ``(path, block, at, value)``; ``at`` orders the lines of a block."""
    return (
        spark.read.option("pathGlobFilter", CSV_FILES).option("recursiveFileLookup", "true").text(path)
        .select(_decoded(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("at"), "value")
    )


def _odd_quotes(line: Column, delimiter: Column) -> Column:
    """Whether a line opens or closes a quoted field that spans lines.

    It has an odd number of quotes, one of them next to a field border; a
    lone quote inside a text, as in 5" pipe, is none.
    """
    n = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    border = (F.startswith(line, F.lit('"')) | F.endswith(line, F.lit('"'))
              | F.contains(line, F.concat(delimiter, F.lit('"'))) | F.contains(line, F.concat(F.lit('"'), delimiter)))
    return (n % 2 == 1) & border


def _header(line: Column, delimiter: Column) -> Column:
    """Column names of a header line; blank ones are numbered."""
    names = split_fields(line, F.coalesce(delimiter, F.lit("\u0000")))
    return F.transform(names, lambda name, i: F.when(
        F.trim(name) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(name))


def _facts(spark: SparkSession, path: str, precedence: str, table_from: str) -> DataFrame:
    """``(table_id, path, encoding, delimiter, line, quotes_odd)`` per file; ``line`` is its first line."""
    first = F.when(F.col("block") == 0, F.col("at"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    files = _lines(spark, path).groupBy("path").agg(
        F.min_by("value", first).alias("raw"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(odd).alias("quotes_odd"))
    line = F.when(F.col("utf8"), F.col("raw")).otherwise(F.decode(F.col("raw").cast("binary"), "ISO-8859-1"))
    return files.withColumn("line", F.regexp_replace(F.rtrim(line, F.lit("\r")), "^\ufeff", "")).select(
        _table_name(F.col("path"), table_from).alias("table_id"), "path",
        F.when(F.col("utf8"), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")).alias("encoding"),
        sniff_delimiter(F.col("line"), precedence).alias("delimiter"), "line", "quotes_odd")


def sniff_lake(spark: SparkSession, path: str, precedence: str = "ingest", table_from: str = "file") -> DataFrame:
    """One pass over the lake: ``(table_id, path, encoding, delimiter, header)`` per file.

    Files are read as splittable text, and each map task reduces its lines to
    one row per file, so the shuffle is as small as the list of files.
    """
    return _facts(spark, path, precedence, table_from).select(
        "table_id", "path", "encoding", "delimiter", _header(F.col("line"), F.col("delimiter")).alias("header"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per-file read options from a manifest CSV (byte-order mark tolerated)."""
    raw = spark.read.option("header", "true").option("escape", '"').csv(path)
    raw = raw.toDF(*[name.lstrip("﻿") for name in raw.columns])
    null_text = F.when(F.col("nullVal") != '""', F.col("nullVal"))
    return raw.select(
        F.col("filename").alias("table_id"),
        F.when(F.col("delimiter") == r"\t", F.lit("\t")).otherwise(F.col("delimiter")).alias("m_delimiter"),
        (F.upper("multiline") == "TRUE").alias("multiline"),
        null_text.alias("null_text"),
        (F.upper("ignoreTrailing") == "TRUE").alias("ignore_trailing"),
    )


def _stitched(lines: DataFrame) -> DataFrame:
    """Lines of files with quoted line breaks as records, each placed where its first line is.

    A line begins a record when the opening and closing lines before it are even in number: one
    running sum per file, which also works across the file's splits.
    """
    order = [F.col("block"), F.col("at")]
    toggles = _odd_quotes(F.col("line"), F.col("delimiter")).cast("long")
    seen = running(lines.withColumn("_toggle", toggles), ["path"], order, {"_seen": F.col("_toggle")})
    begins = ((F.col("_seen") - F.col("_toggle")) % 2 == 0).cast("long")
    records = running(seen, ["path"], order, {"_record": begins})
    keep = [c for c in lines.columns if c not in ("block", "at", "line")]
    parts = F.sort_array(F.collect_list(F.struct("block", "at", "line")))  # the lines of one record
    whole = records.groupBy("path", "_record").agg(
        parts.alias("_parts"), *[F.first(c).alias(c) for c in keep if c != "path"])
    return whole.select(
        *keep, F.col("_parts")[0]["block"].alias("block"), F.col("_parts")[0]["at"].alias("at"),
        F.array_join(F.transform("_parts", lambda p: p["line"]), "\n").alias("line"))


def read_lake(spark: SparkSession, path: str, manifest: DataFrame | None = None,
              precedence: str = "ingest", table_from: str = "file") -> DataFrame:
    """All delimited files under ``path`` as ``cells``.

    Two scans of the folder whatever it holds: one for the facts of each file
    (``sniff_lake``), one for the rows, which meet their file's facts in a join;
    no list of paths passes through the driver.  A record may span lines inside quotes, where the manifest says
    so or, without a manifest entry, where a line has an odd number of quotes.  A record with more
    fields than the header is malformed and left out; a shorter one is padded.  Rows
    are numbered inside the split they come from (a bounded group) and shifted by the
    rows of the table's earlier splits.  A table is a file, or
    (``table_from="folder"``) a folder of part files.
    """
    files = _facts(spark, path, precedence, table_from)
    if manifest is None:
        files = files.withColumns({"multiline": F.col("quotes_odd"), "null_text": F.lit(None).cast("string"),
                                   "ignore_trailing": F.lit(False)})
    else:
        files = files.join(manifest, "table_id", "left").withColumns({
            "delimiter": F.coalesce("m_delimiter", "delimiter"), "multiline": F.coalesce("multiline", "quotes_odd"),
            "ignore_trailing": F.coalesce("ignore_trailing", F.lit(False))}).drop("m_delimiter")
    files = files.withColumn("delimiter", F.coalesce("delimiter", F.lit("\u0000")))
    files = materialize(files.withColumn("header", _header(F.col("line"), F.col("delimiter"))).drop("line"))
    if files.isEmpty():
        raise ValueError(f"no delimited files under {path}")

    lines = _lines(spark, path).join(files.drop("table_id", "header"), "path")
    text = F.when(F.col("encoding") == "UTF-8", F.col("value")).otherwise(
        F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    lines = lines.withColumn("line", F.rtrim(text, F.lit("\r"))).drop("value", "encoding", "quotes_odd")
    records = lines.filter(~F.col("multiline")).unionByName(_stitched(lines.filter("multiline")))
    fields = split_fields(F.col("line"), F.col("delimiter"))
    fields = F.transform(fields, lambda f: F.when(F.col("ignore_trailing"), F.rtrim(f)).otherwise(f))
    widths = files.select("path", F.size("header").alias("n_cols"))
    rows = materialize(
        records.select("path", "block", "at", "null_text", fields.alias("fields"), (F.trim("line") == "").alias("blank"))
        .join(widths, "path").filter(~F.col("blank") & (F.size("fields") <= F.col("n_cols"))).drop("blank", "n_cols"))

    in_split = F.row_number().over(Window.partitionBy("path", "block").orderBy("at"))
    sizes = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("n", F.col("n") - (F.col("block") == 0).cast("long"))  # the header line
    table = _table_name(F.col("path"), table_from) if table_from == "folder" else F.col("path")
    earlier = Window.partitionBy(table).orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    numbered = rows.withColumn("pos", in_split - 1 - (F.col("block") == 0).cast("int")).filter("pos >= 0").join(
        starts, ["path", "block"])
    cell = F.col("cell.fields")
    missing = cell.isNull() | cell.isin(MISSING_FIELDS) | F.coalesce(cell == F.col("null_text"), F.lit(False))
    return (
        numbered.join(files.select("path", "table_id", "header"), "path")
        .select("table_id", "null_text", (F.col("start") + F.col("pos")).cast("long").alias("row_idx"),
                F.posexplode(F.arrays_zip("header", "fields")).alias("col_idx", "cell"))
        .select("table_id", "row_idx", "col_idx", F.col("cell.header").alias("col_name"),
                F.when(~missing, cell).alias("value"))
    )


def to_cells(df: DataFrame, columns: dict[str, Column], headers: dict[str, Column] | None = None) -> DataFrame:
    """Rows with ``table_id`` and ``row_idx`` as cells; ``columns`` gives each cell's text.

    ``headers`` gives column names that depend on the row's table; by default they are the keys of
    ``columns``.  Unpivoting expands rows without building arrays, so a consumer that reads
    no values (row counts, header lists) prunes the columns at the scan.
    """
    slots = {str(i): value.cast("string") for i, value in enumerate(columns.values())}
    heads = {f"_h{i}": name for i, name in enumerate((headers or {}).values())}
    wide = df.select("table_id", F.col("row_idx").cast("long").alias("row_idx"),
                     *[name.alias(h) for h, name in heads.items()], *[value.alias(slot) for slot, value in slots.items()])
    names = F.array(*(heads or [F.lit(name) for name in columns]))
    return (
        wide.unpivot(["table_id", "row_idx", *heads], list(slots), "slot", "value")
        .withColumn("col_idx", F.col("slot").cast("int"))
        .select("table_id", "row_idx", "col_idx", F.get(names, F.col("col_idx")).alias("col_name"), "value")
    )


def table_cells(df: DataFrame, table_id: str, row_idx: str, columns: dict[str, Column]) -> DataFrame:
    """One wide DataFrame as the cells of one table."""
    keyed = df.withColumns({"table_id": F.lit(table_id), "row_idx": F.col(row_idx)})
    return to_cells(keyed, columns)
