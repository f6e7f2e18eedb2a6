"""Line dedup: drop lines that many documents share, as run-length bitmaps of kept lines.

Method: the hashes of all long lines are range-partitioned and sorted within
their key by document (largest first) and position.  One streaming pass marks
the first line of every (key, document), which gives the documents per key and
the document that keeps its lines.  What goes back to the documents is one
short bitmap each (runs of kept lines), never text.

DataFrame functions only.  A key that a third of all rows share is dealt over
as many slices as there are shuffle partitions (slice = hash of the document),
so the sort, the marks and the join back stay even.

Defined results: a null or empty text is one empty line, which stays.  Rows
that share doc_id count as one document; equal rows get equal results, and
rows with one id but different texts are decided line by line on their own.  A null id is a document
of its own, smaller than every other id.  Further columns are ignored by the bitmaps and
kept by ``drop_repeated_lines``.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakefind.llm.common import BLANKS, ascii_lower, packed, shuffle_partitions, table
from lakefind.plans.registry import query
from lakefind.session import materialize

MIN_CHARS, MIN_DOCS = 40, 5


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, body, n_lines, pos, h1, h2) of lines whose key has ``min_chars``; h1 and h2 are 128 bits of the key."""
    lines = docs.select(
        F.col("doc_id").alias("doc"), F.xxhash64("text").alias("body"), split_lines(F.col("text")).alias("lines"))
    at = lines.select("doc", "body", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    at = at.select("doc", "body", "n_lines", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    key = ascii_lower(F.col("key"))
    return at.where(F.length("key") >= min_chars).select(
        "doc", "body", "n_lines", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, body, n_lines, n_dropped, keep) for documents that lose lines; all others keep every line.

    ``keep`` is a run-length bitmap: structs (start, length) of kept lines, in
    order.  ``body`` is the hash of the text and tells rows of one id apart.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = long_lines(docs, min_chars).withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(n)).cast("int"))
    at = Window.partitionBy("h1", "h2", "slice").orderBy(F.col("doc").desc(), "pos")
    first = F.when(F.row_number().over(at) == 1, 1).otherwise(
        F.when(F.col("doc").eqNullSafe(F.lag("doc").over(at)), 0).otherwise(1))
    marks = materialize(rows.repartitionByRange(n, "h1", "h2", "slice").withColumn("first", first))

    slices = marks.groupBy("h1", "h2", "slice").agg(F.sum("first").alias("n_docs"), F.max("doc").alias("top"))
    shared = slices.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top")).where(
        F.col("n_docs") >= min_docs).select("h1", "h2", "top")
    of_slice = slices.select("h1", "h2", "slice").join(shared, ["h1", "h2"])
    gone = marks.join(of_slice, ["h1", "h2", "slice"]).where(~F.col("doc").eqNullSafe(F.col("top")))

    gone = gone.groupBy("doc", "body").agg(
        F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda x, i: (i == 0) | (F.get("at", i - 1) != x - 1))
    ends = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1) != x + 1, F.lit(True)))
    # arrays that the functions below look into are columns of their own, not computed anew per element
    runs = gone.select("doc", "body", "n_lines", F.size("at").alias("n_dropped"),
                       F.arrays_zip(starts.alias("s"), ends.alias("e")).alias("gaps"))

    def run(k: Column) -> Column:
        begin = F.coalesce(F.get("gaps", k - 1)["e"] + 1, F.lit(0))
        return F.struct(begin.alias("start"), (F.coalesce(F.get("gaps", k)["s"], F.col("n_lines")) - begin).alias("length"))

    keep = F.filter(F.transform(F.sequence(F.lit(0), F.size("gaps")), run), lambda r: r["length"] > 0)
    return runs.select("doc", "body", "n_lines", "n_dropped", keep.alias("keep"))


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Each row of ``docs`` as struct ``row``, with n_lines, n_dropped and the ``kept`` text."""
    rows = packed(docs, doc=F.col("doc_id"), body=F.xxhash64("text")).alias("d")
    maps = bitmaps.select("doc", "body", "n_dropped", "keep").alias("b")
    both = rows.join(
        maps, F.col("d.doc").eqNullSafe(F.col("b.doc")) & (F.col("d.body") == F.col("b.body")), "left")
    both = both.select("row", "n_dropped", "keep", split_lines(F.col("row.text")).alias("lines"))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice("lines", r["start"] + 1, r["length"]))), "\n")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return both.select(
        "row", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), text).otherwise(kept).alias("kept"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` documents share; a changed text gets its own ``n_chars``."""
    kept = with_kept_text(docs, keep_bitmaps(docs, min_chars, min_docs))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@query("op2_line_dedup", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND s.top <> k.doc_id AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kept = with_kept_text(docs, keep_bitmaps(docs))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                       F.sha2("kept", 256).alias("kept_sha256"))
