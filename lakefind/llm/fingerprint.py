"""Document fingerprints: quartile bucket digests and their bounded difference score.

Every window of five bytes gives six hashed byte triplets; 256 buckets count
them over the whole text.  A digest holds the length's logarithm, the ratios of
the count quartiles and, for each bucket, the quartile its count falls in (two
bits).  The difference of two digests adds, per bucket, the squared quartile distance,
and penalties for length and ratios; ``likeness`` maps it to 0..1.

Counts are scaled by the text's length where documents differ in size, because
quartiles are relative.  Long texts are counted piece by piece.

``neighbours`` pairs each document with the next one by ascending id: ids are
range-partitioned and sorted, each task walks its slice, and only the last row of
a slice meets the first row of the next slice in a join.  Text is
shuffled once.

Defined results: a null text is empty; an empty text has the all-zero digest,
and two empty texts are alike (1.0), an empty and another text are not (0.0).  Rows that share an id come in the order of their
64-bit text hash, then their text.  A null id sorts first.  A single document is its own next one.
Further columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.llm.common import mix, shuffle_partitions, short_batches, table
from lakefind.plans.registry import query
from lakefind.session import materialize

BUCKETS = 256
PIECE = 1 << 20
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))  # bytes of a window of five
#: One substitution of byte values per place and kind of triplet, from a rule: the order of scrambled numbers.
TABLES = [[np.argsort(mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * k + 10_000 * p))).astype(np.uint8)
           for p in range(3)] for k in range(len(TRIPLETS))]
SCALE = 600.0  # a difference at which the likeness is 1/e


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the hashed triplets of all windows."""
    total = np.zeros(BUCKETS, np.int64)
    for lo in range(0, max(1, len(data)), PIECE):
        x = np.frombuffer(data[lo:lo + PIECE + 4], np.uint8)
        if len(x) < 5:
            if lo:
                break
            x = np.concatenate([x, np.zeros(5 - len(x), np.uint8)])
        n = len(x) - 4
        for (i, j, k), (a, b, c) in zip(TRIPLETS, TABLES, strict=True):
            total += np.bincount(c[b[a[x[i:i + n]] ^ x[j:j + n]] ^ x[k:k + n]], minlength=BUCKETS)
    return total


@lru_cache(maxsize=4)  # a neighbour's digest is its own one step later
def digest(text: str) -> str:
    """Hex digest: length code, two quartile ratios, then two bits for each bucket."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return "00" * (2 + BUCKETS // 4)
    counts = bucket_counts(data)
    q1, q2, q3 = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[
        [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = 1 + min(254, int(np.log(len(data)) * 12))
    low = int(q1 * 15 // q3) if q3 else 0
    mid = int(q2 * 15 // q3) if q3 else 0
    quads = code.reshape(-1, 4)
    packed = (quads[:, 0] << 6) | (quads[:, 1] << 4) | (quads[:, 2] << 2) | quads[:, 3]
    return bytes([length, low << 4 | mid]).hex() + packed.astype(np.uint8).tobytes().hex()


def difference(x: str, y: str) -> float:
    """0 for equal digests; at most 9 a bucket and the penalties for length and ratios."""
    a, b = np.frombuffer(bytes.fromhex(x), np.uint8), np.frombuffer(bytes.fromhex(y), np.uint8)
    lengths = abs(int(a[0]) - int(b[0]))
    ratios = abs(int(a[1] >> 4) - int(b[1] >> 4)) + abs(int(a[1] & 15) - int(b[1] & 15))
    shifts = np.array([6, 4, 2, 0], np.uint8)
    codes = ((v[2:, None] >> shifts & 3).astype(np.int64) for v in (a, b))
    away = np.abs(np.subtract(*codes))
    return float((away * away).sum() + min(60, lengths) + 2 * ratios)


def likeness(x: str, y: str) -> float:
    """1 for equal digests, falling towards 0 with the difference."""
    if x == y:
        return 1.0
    if not any(bytes.fromhex(x)) or not any(bytes.fromhex(y)):
        return 0.0
    return float(np.exp(-difference(x, y) / SCALE))


def neighbours(docs: DataFrame, compare: Callable[[int | None, str, str], tuple], schema: str) -> DataFrame:
    """``compare(doc_id, text, next text)`` for every document, the next one by ascending id; the first follows the last.

    ``schema`` names what ``compare`` returns.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    # ranges of id and text hash: rows that share an id, or have none, spread over slices too
    rows = rows.repartitionByRange(shuffle_partitions(spark), *order[:2]).sortWithinPartitions(*order)
    rows = rows.withColumn("slice", F.spark_partition_id())
    done = spark.createDataFrame([], schema).schema
    arrow = [(f.name, f.dataType.simpleString()) for f in done.fields]
    types = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}

    def batch(found: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
        """Finished rows, then ends of slices: (slice, whether it is the last row, id, text)."""
        pad = (None,) * len(arrow)
        lines = [(*x, None, None, None, None) for x in found] + [(*pad, *x) for x in ends]
        kinds = [types[t] for _, t in arrow] + [pa.int32(), pa.bool_(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in lines], kind) for k, kind in enumerate(kinds)],
            [n for n, _ in arrow] + ["slice", "last", "end_id", "end_text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            found, ends = [], []
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "slice")), strict=True):
                if before is None:
                    ends.append((row[2], False, row[0], row[1]))
                else:
                    found.append(compare(before[0], before[1], row[1]))
                before = row
            yield batch(found, ends)
        if before is not None:
            yield batch([], [(before[2], True, before[0], before[1])])

    written = materialize(rows.mapInArrow(walk, f"{schema}, slice int, last boolean, end_id bigint, end_text string"))
    inner = written.where("slice is null").select(*done.names)
    slices = sorted(r["slice"] for r in written.where("last").select("slice").collect())  # one number per task
    if not slices:
        return inner
    follows = spark.createDataFrame(list(zip(slices, [*slices[1:], slices[0]], strict=True)), "slice int, after int")
    tails = written.where("last").join(follows, "slice").select(
        F.col("end_id").alias("doc_id"), F.col("end_text").alias("text"), F.col("after").alias("slice"))
    heads = written.where("not last").select("slice", F.col("end_text").alias("next_text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [compare(*r) for r in zip(
                *(b.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in found], types[t]) for k, (_, t) in enumerate(arrow)], done.names)

    outer = tails.join(heads, "slice").select("doc_id", "text", "next_text").mapInArrow(finish, schema)
    return inner.unionByName(outer)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def edit_report(doc_id: int | None, text: str, following: str) -> tuple:
    other = edited(text, following)
    own, changed = digest(text), digest(other)
    return (doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), own, changed,
            likeness(own, changed), likeness(own, digest(following)))


EDIT_SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([digest(t or "") for t in b.column("text").to_pylist()], pa.string())],
                ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, fingerprint string")


@query("op8_document_fingerprints")
def op8_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(table(spark, sf, "documents"), edit_report, EDIT_SCHEMA)
