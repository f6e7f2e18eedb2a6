"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.session import short_batches  # noqa: F401  (for the operators of this subpackage)

#: ASCII white space: 0x20 and 0x09 to 0x0D (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, lower-cased."""
    return F.translate(text, UPPER, UPPER.lower())


def id_remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """All columns of ``df`` as one struct ``row`` beside ``keys``, so that no name of ``df`` can clash."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64; fixed multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash(dict):
    """64-bit hashes of words (bytes), each computed once; forgotten when there are too many."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased; both are ASCII only for bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split()


SHINGLE = 5
_LANES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_runs(words: list[list[bytes]], known: WordHash, size: int = SHINGLE) -> list[np.ndarray]:
    """The shingle hashes of each document, one per position.

    Fewer than ``size`` words make one shingle of the whole sequence, no words
    make none.  All documents of the call are hashed in one go.
    """
    pad = [b""] * size
    flat = [w if len(w) >= size or not w else w + pad[len(w):] for w in words]
    sizes = np.array([len(w) for w in flat], np.int64)
    total = int(sizes.sum())
    hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(flat)), np.uint64, total)
    out = np.zeros(max(0, total - size + 1), np.uint64)
    for k in range(size):
        out += hashes[k:k + len(out)] * _LANES[k]
    out = mix(out)
    ends = np.cumsum(sizes)
    return [out[e - n:e - size + 1] if n else out[:0] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def batched(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Apply ``make`` to every batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield make(batch)
