"""Line dedup against a direct version."""

import hashlib
from collections import defaultdict

from lakefind.llm import line_dedup as D
from llm_cases import documents, odd_rows, words
from pyspark.sql import functions as F

LONG = "x" * 25 + " SHARED line " + "y" * 25


def brute(rows, min_chars=40, min_docs=5):
    """(id, n_lines, n_dropped, kept) per row."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    rank = lambda i: (i is not None, i or 0)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)], key=rank) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shared_rows():
    rows = [(k, f"{words(k, 5)}\n  {LONG.lower() if k % 2 else LONG}\t\n{words(k + 50, 12)}\n{LONG}") for k in range(20, 27)]
    few = "few " + "z" * 50
    rows += [(k, f"{few}\n{words(k, 4)}") for k in range(40, 44)]  # four documents only
    rows += [(None, f"{LONG}\nend"), (30, f"{LONG}\n\n{LONG}"), (31, LONG)]
    return rows + odd_rows() + [(5, odd_rows()[0][1])] * 3


def test_matches_a_direct_version(spark):
    rows = shared_rows()
    docs = documents(spark, rows)
    kept = D.with_kept_text(docs, D.keep_bitmaps(docs)).select("row.doc_id", "n_lines", "n_dropped", "kept")
    show = lambda x: sorted(map(repr, x))
    assert show(map(tuple, kept.collect())) == show(brute(rows))


def test_drops_lines_and_keeps_columns(spark):
    docs = documents(spark, shared_rows())
    out = D.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    row = out.where("doc_id = 20").first()
    assert LONG not in row["text"] and row["n_chars"] == len(row["text"])
    assert out.where("doc_id = 31").first()["text"] == LONG  # the largest id keeps it
    assert out.where("doc_id = 2").first()["text"] is None


def test_bitmap_is_a_run_length_list(spark):
    rows = [(k, f"{LONG}\nkeep\nkeep\n{LONG}\nend") for k in range(5)]
    maps = {r["doc"]: r for r in D.keep_bitmaps(documents(spark, rows)).collect()}
    assert set(maps) == {0, 1, 2, 3}
    assert [tuple(x) for x in maps[0]["keep"]] == [(1, 2), (4, 1)] and maps[0]["n_dropped"] == 2


def test_line_of_a_third_of_all_rows_is_split_over_slices(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(LONG + "\nend")).otherwise(
        F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    out = D.drop_repeated_lines(docs)
    assert out.where(F.contains("text", F.lit(LONG))).select("doc_id").collect() == [(2997,)]
    assert out.where("text = 'end'").count() == 999


def test_empty_table(spark):
    docs = documents(spark, [])
    assert D.drop_repeated_lines(docs).count() == 0
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
