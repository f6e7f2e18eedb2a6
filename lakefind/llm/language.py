"""Language ID by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three
letters, a run of other characters counting as one blank).  A document's
profile is compared to each language's by out-of-place distance: the sum of
rank differences, with ``SIZE`` for an n-gram that the language lacks.

Learning counts n-grams over all given rows: each task sums its own counts per
language and n-gram, Spark sums those and keeps the first ``SIZE`` ranks of each
language.  What the driver sees and broadcasts is ``SIZE`` n-grams per language.
Long texts are counted piece by piece.

Defined results: a null text and a text without a letter get ``und`` with score 0.
Without any learned language every text gets ``und``.  Ties in frequency go by the n-gram's
code, ties in distance by the language's name.  Rows with a null language are
not learned from.  Repeated rows count as often as they occur and get equal results.  Further
columns are kept in ``row``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakefind.llm.common import id_remainder, packed, short_batches, table
from lakefind.plans.registry import query

UNKNOWN = "und"
SIZE, ORDERS = 400, (1, 2, 3)
FOLDS, HELD_OUT = 4, 2
PIECE = 1 << 20
FLUSH = 2_000_000  # n-grams that a task holds before it passes its sums on
BITS = np.uint64(21)  # of a code point


def letter_codes() -> np.ndarray:
    """Lower-case letter of every code point, 0 for other characters."""
    codes = np.zeros(0x110000, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            codes[k] = ord(low) if len(low) == 1 else k
    return codes


class Grams:
    """Counts n-grams of texts; an n-gram is a number of 21 bits a letter, blanks as 0 with a set top bit."""

    def __init__(self):
        self.codes = letter_codes()

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of a text, ascending, and their counts; none for a text without letters."""
        parts = [self.piece(text[lo:lo + PIECE]) for lo in range(0, len(text), PIECE)]
        parts = [p for p in parts if p is not None]
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(parts) == 1:
            return parts[0]
        grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

    def piece(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = self.codes[raw]
        if not code.any():
            return None
        code = np.concatenate([[0], code, [0]]).astype(np.uint64)
        code = code[(code != 0) | np.concatenate([[True], code[:-1] != 0])]  # one blank for a run
        grams = [code[code != 0]]
        pair = (code[:-1] << BITS) | code[1:]
        grams.append(pair | np.uint64(1 << 63))
        if len(code) > 2:
            triple = (pair[:-1] << BITS) | code[2:]
            grams.append(triple[code[1:-1] != 0])  # not two words' ends
        out = np.sort(np.concatenate(grams))
        first = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))
        return out[first], np.diff(np.concatenate([first, [len(out)]]))


def top(grams: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The most frequent n-grams in rank order; ties by code."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(rows: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language in ``rows`` (lang, text)."""
    short_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held, sums = Grams(), 0, {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            return grams, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in sums.items():
                grams, counts = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)],
                    ["lang", "gram", "n"])
            sums.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                grams, counts = counter.count(text or "")
                if len(grams):
                    sums.setdefault(lang, []).append((grams, counts))
                    held += len(grams)
            if held > FLUSH:
                sums = {lang: [merged(parts)] for lang, parts in sums.items()}
                held = sum(len(parts[0][0]) for parts in sums.values())
                if held > FLUSH // 2:
                    yield from flush()
                    held = 0
        yield from flush()

    counts = rows.where("lang is not null").select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a rank within each language; Spark keeps the first SIZE rows per task before the shuffle
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = total.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    found: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, np.int64).view(np.uint64) for lang, grams in found.items()}


class Profiles:
    """Ranks of every n-gram in every language."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = SIZE):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def best(self, document: np.ndarray) -> tuple[str, float]:
        """The nearest language of a ranked profile, and 1 - its distance as a share of the largest one."""
        if not len(document) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, document)
        at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] != document)] = len(self.grams)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(document))[:, None])).sum(0)
        k = int(away.argmin())
        return self.langs[k], 1 - float(away[k]) / (self.size * len(document))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with lang_pred and score, from its whole text."""
    short_batches(docs.sparkSession)
    keyed = packed(docs, text=F.col("text"))
    schema = keyed.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    known = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, found = Grams(), known.value
        for b in batches:
            best = [found.best(top(*counter.count(t or ""))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([x[0] for x in best], pa.string()),
                 pa.array([x[1] for x in best], pa.float64())], ["row", "lang_pred", "score"])

    return keyed.mapInArrow(run, schema)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    learned = docs.where(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    found = identify(docs.select("doc_id", "text"), learn_profiles(learned))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        (id_remainder(F.col("row.doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
