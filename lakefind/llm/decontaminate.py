"""Benchmark decontamination: SimHash windows of item size, Hamming blocks, exact weighted-shingle check.

For an item of m words every window of m consecutive words of a document (the
whole document, if it is shorter) gets a 128-bit SimHash of its word shingles,
weighted by how often they occur.  Eight blocks of 16 bits index the items:
each block is stored with all values up to RADIUS // 8 bits away, so by the
pigeonhole principle every pair of fingerprints within RADIUS bits meets in a
block.  Pairs that meet are compared exactly: the sum of minima over the sum of maxima of the
shingle weights must be at least 0.8.

Only windows that could pass this check get a fingerprint: a window must hold
ceil(4/9 * (its shingles + the item's)) positions whose shingle occurs in an
item of its size, a condition that the exact check implies.  RADIUS is the one
place where a pair at the very threshold can be lost: at similarity 0.8 the
expected distance is 19 of 128 bits with a deviation of 4.

Scale: documents are read once per ``MAX_CHARS`` characters of benchmark text; what each
pass broadcasts is bounded by that.  Document text is never shuffled.  Candidate
windows and the item index meet in an equi-join.

Defined results: null, empty and blank texts and items match nothing.  Items or
windows with fewer than five words are one shingle.  Repeated rows give one row per
(doc_id, item_id).  A null doc_id or item_id is an id like any other.  Further columns are
ignored.  Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.llm.common import SHINGLE, WordHash, mix, packed, shingle_runs, short_batches, table, words_of
from lakefind.plans.registry import query
from lakefind.session import materialize

SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 128, 8, 31
MAX_CHARS = 8_000_000  # benchmark text handled in one pass


def needed(window: int, item: int) -> int:
    """The least common weight of two windows with this many shingles at similarity 0.8."""
    return -(-4 * (window + item) // 9)


def fingerprint(tokens: np.ndarray) -> np.ndarray:
    """SimHash: sign of the weighted votes, as BLOCKS 16-bit numbers."""
    lanes = np.stack([mix(tokens), mix(tokens ^ np.uint64(0x5851F42D4C957F2D))], 1)
    votes = np.unpackbits(lanes.view(np.uint8), axis=1).astype(np.int32).sum(0) * 2 - len(tokens)
    return np.packbits(votes > 0).view(">u2").astype(np.int32)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingle hashes."""
    both = np.concatenate([x, y])
    _, inverse = np.unique(both, return_inverse=True)
    a = np.bincount(inverse[:len(x)], minlength=inverse.max() + 1)
    b = np.bincount(inverse[len(x):], minlength=inverse.max() + 1)
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


class ItemIndex:
    """Shingles of a bounded part of the benchmark and the item sizes each occurs in."""

    def __init__(self, texts: list[str]):
        words = [words_of(t) for t in texts]
        runs = shingle_runs(words, WordHash())
        pairs = {(int(h), len(w)) for w, r in zip(words, runs, strict=True) for h in r.tolist()}
        self.hashes = np.unique(np.array([h for h, _ in pairs], np.uint64))
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        self.of_size: dict[int, np.ndarray] = {}
        for size in sorted({m for _, m in pairs}):
            self.of_size[size] = np.unique(np.array([h for h, m in pairs if m == size], np.uint64))

    @staticmethod
    def member(sorted_hashes: np.ndarray, run: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(sorted_hashes, run), len(sorted_hashes) - 1)
        return sorted_hashes[at] == run

    def windows(self, words: list[bytes], run: np.ndarray, known: WordHash) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, item size, shingles) of every window that could reach the similarity."""
        n = len(words)
        for size in (m for m in self.of_size if m < SHINGLE):  # such items are one shingle of fewer words
            for k in range(n - size + 1):
                short = shingle_runs([words[k:k + size]], known)[0]
                if self.member(self.of_size[size], short).all():
                    yield k, size, short
        if n < SHINGLE or not len(self.hashes):
            return
        hit = np.flatnonzero(self.maybe[(run >> np.uint64(48)).astype(np.int64)])
        hit = hit[self.member(self.hashes, run[hit])] if len(hit) else hit
        if not len(hit):
            return
        for size, own in self.of_size.items():
            if size < SHINGLE:
                continue
            width, item = min(len(run), size - SHINGLE + 1), size - SHINGLE + 1
            need = needed(width, item)
            if len(hit) < need:
                continue
            at = hit[self.member(own, run[hit])]
            if len(at) < need:
                continue
            held = np.zeros(len(run) + 1, np.int64)
            held[at + 1] = 1
            held = np.cumsum(held)
            for k in np.flatnonzero(held[width:] - held[:-width] >= need).tolist():
                yield k, size, run[k:k + width]


def item_windows(docs: DataFrame, index: ItemIndex) -> DataFrame:
    """(doc_id, start, size, fp, tokens) of candidate windows."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, items = WordHash(), shared.value
        for b in batches:
            words = [words_of(t or "") for t in b.column("text").to_pylist()]
            rows = [(d, k, m, fingerprint(tokens).tolist(), tokens.tobytes())
                    for d, w, r in zip(b.column("doc_id").to_pylist(), words, shingle_runs(words, known), strict=True)
                    for k, m, tokens in items.windows(w, r, known)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()])],
                ["doc_id", "start", "size", "fp", "tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, size int, fp array<int>, tokens binary")


def item_table(spark: SparkSession, items: list[tuple[int | None, str]]) -> DataFrame:
    """(item_id, size, item_fp, item_tokens) of a bounded part of the benchmark."""
    known, rows = WordHash(), []
    for item, text in items:
        words = words_of(text)
        if words:
            tokens = shingle_runs([words], known)[0]
            rows.append((item, len(words), fingerprint(tokens).tolist(), bytearray(tokens.tobytes())))
    return spark.createDataFrame(rows, "item_id bigint, size int, item_fp array<int>, item_tokens binary")


def matches_of(docs: DataFrame, items: list[tuple[int | None, str]]) -> DataFrame:
    """All (doc_id, item_id, start, n_words, similarity) at the similarity or above."""
    spark = docs.sparkSession
    item_rows = item_table(spark, items)
    windows = materialize(item_windows(docs, ItemIndex([t for _, t in items])))
    near = [sum(1 << k for k in flips) for r in range(RADIUS // BLOCKS + 1)
            for flips in combinations(range(BITS // BLOCKS), r)]
    index = item_rows.select("item_id", "size", "item_fp", F.posexplode("item_fp").alias("block", "value"))
    index = index.select("item_id", "size", "item_fp", "block",
                         F.explode(F.array([F.lit(x) for x in near])).alias("flip"), "value")
    index = index.select("item_id", "size", "item_fp", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    blocks = windows.select("doc_id", "start", "size", "fp", F.posexplode("fp").alias("block", "value"))
    far = F.aggregate(F.zip_with("fp", "item_fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = blocks.join(index, ["size", "block", "value"]).where(far <= RADIUS).select(
        "doc_id", "start", "size", "item_id").distinct()
    full = pairs.alias("p").join(
        windows.dropDuplicates(["doc_id", "start", "size", "tokens"]).alias("w"),
        F.col("p.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("p.start") == F.col("w.start"))
        & (F.col("p.size") == F.col("w.size"))).join(
        item_rows.select("item_id", "size", "item_tokens").alias("i"),
        F.col("p.item_id").eqNullSafe(F.col("i.item_id")) & (F.col("p.size") == F.col("i.size")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(
                b.column("tokens").to_pylist(), b.column("item_tokens").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "item_id", "start", "size")), pa.array(score, pa.float64())],
                ["doc_id", "item_id", "start", "n_words", "similarity"])

    return full.select("p.doc_id", "p.item_id", "p.start", "p.size", "tokens", "item_tokens").mapInArrow(
        run, "doc_id bigint, item_id bigint, start bigint, n_words int, similarity double").where(
        F.col("similarity") >= SIMILARITY - 1e-12)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The best window per (doc_id, item_id): start (word), n_words and similarity."""
    spark = docs.sparkSession
    short_batches(spark)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-size // MAX_CHARS) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    found = [matches_of(docs, [(r["item_id"], r["text"]) for r in items.where(part == k).distinct().collect()])
             for k in range(passes)]
    best = F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start"))).alias("best")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.start", "best.n_words", "best.similarity")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    leaked = contamination(docs, benchmark).select(F.col("doc_id").alias("leaked")).distinct()
    rows = packed(docs, id=F.col("doc_id").cast("bigint"))
    return rows.join(leaked, rows["id"].eqNullSafe(leaked["leaked"]), "left_anti").select("row.*")


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
