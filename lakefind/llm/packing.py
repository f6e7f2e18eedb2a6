"""Best-fit packing by sum of squares: fixed-length training sequences from whole documents.

A document's ids are those of the given tokenizer followed by one id 0.  Documents longer than a sequence are
cut into full pieces and a rest; nothing else is cut.  A piece goes where the
sum over residual gaps of (open sequences with this gap) squared becomes
smallest: into an open sequence, or into a new one.  Ties take the smallest gap left, so a perfect fit comes first.

Scale: pieces are numbered and dealt by number over shards of about ``SHARD`` pieces, so a third of all
rows under one id (or none) still fills all shards alike, and each
shard is packed on its own from (id, piece, length) alone; the waste of a shard
is a few open sequences, a fixed small share.  Token ids never go through a
shuffle for packing.  A long text is tokenised segment by segment.

Tokens: the tokenizer never joins characters across white space, so texts are
encoded in blocks between ASCII white space, each distinct block once, and
plain blocks as their run of letters and their run of signs.  The ids equal
those of the whole text, which a test compares.

Defined results: a null or empty text is one piece with the single id 0.
Repeated rows are packed as separate, equal pieces.  Null ids stay null.  Further columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.functions.ranking import rank_within
from lakefind.llm.common import short_batches, table
from lakefind.plans.registry import query
from lakefind.session import materialize

CAPACITY, END = 2048, 0
SHARD = 24_000
SEGMENT = 1 << 20  # characters tokenised at once
CACHE = 150_000  # blocks, and runs of blocks, of one generation; two generations of both take about 100 MB
#: Blocks that are one run of Latin letters and one run of ASCII signs: each run is a word of the tokenizer's model.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class BlockEncoder:
    """Ids of texts (little-endian uint32 bytes), each distinct block between white space encoded once.

    What is known is kept in two generations: when the young one is full it becomes the old one, and what is
    met again moves back, so frequent blocks stay and memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(len(vocabulary), bool)  # ids that end a word
        self.last[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        # plain runs in lower case are what the normaliser would make of them, and blanks part them
        self.simple = Tokenizer(self.tokenizer.model)  # the same model, not a copy
        self.simple.normalizer = normalizers.Sequence([])
        self.simple.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.old_known: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}

    def age(self) -> None:
        if len(self.known) > CACHE:
            self.old_known, self.known = self.known, {}
        if len(self.runs) > CACHE:
            self.old_runs, self.runs = self.runs, {}

    @staticmethod
    def encode(tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    @staticmethod
    def segments(text: str) -> Iterator[list[str]]:
        """Blocks of about ``SEGMENT`` characters at a time, cut at white space only."""
        lo = 0
        while lo < len(text):
            hi = lo + SEGMENT
            if hi < len(text):
                cuts = [c for c in (text.find(w, hi) for w in " \n\t\r") if c >= 0]
                hi = min(cuts, default=len(text))
            part = text[lo:hi].replace("\n", " ").replace("\t", " ").replace("\r", " ")
            yield [w for w in part.split(" ") if w]
            lo = hi

    def learn(self, new: set[str]) -> None:
        self.age()
        plain, other = [], []
        for b in new:
            m = PLAIN.fullmatch(b)
            if m:
                plain.append((b, m[1].lower(), m[2]))
            else:
                other.append(b)
        unknown = set()
        for r in {r for _, word, signs in plain for r in (word, signs) if r and r not in self.runs}:
            ids = self.old_runs.get(r)
            if ids is None:
                unknown.add(r)
            else:
                self.runs[r] = ids
        self.learn_runs(unknown)
        for b, word, signs in plain:
            self.known[b] = self.runs.get(word, b"") + self.runs.get(signs, b"")
        for b in other:
            self.known[b] = self.encode(self.tokenizer, b).tobytes()

    def learn_runs(self, runs: set[str]) -> None:
        """Many runs in one call; each is one word of the model and so has one id that ends a word, its last."""
        new = list(runs)
        for lo in range(0, len(new), 4096):
            part = new[lo:lo + 4096]
            ids = self.encode(self.simple, " ".join(part))
            data, at = ids.tobytes(), 0
            for run, end in zip(part, (np.flatnonzero(self.last[ids]) + 1).tolist(), strict=True):
                self.runs[run] = data[4 * at:4 * end]
                at = end

    def ids(self, text: str) -> Iterator[bytes]:
        """The text's ids, a segment at a time."""
        for blocks in self.segments(text):
            found = list(map(self.known.get, blocks))
            missing = [i for i, ids in enumerate(found) if ids is None]
            if missing:
                new = set()
                for block in {blocks[i] for i in missing}:
                    ids = self.old_known.get(block)
                    if ids is None:
                        new.add(block)
                    else:
                        self.known[block] = ids
                self.learn(new)
                for i in missing:
                    found[i] = self.known.get(blocks[i]) or self.old_known.get(blocks[i], b"")
            yield b"".join(found)


@lru_cache(maxsize=1)
def block_encoder(path: str) -> BlockEncoder:
    """One encoder per worker process, kept from task to task."""
    return BlockEncoder(path)


def cut(encoder: BlockEncoder, text: str, capacity: int = CAPACITY) -> Iterator[bytes]:
    """Pieces of the document's ids, the end id included; all but the last are full."""
    rest, size = b"", 4 * capacity
    for part in encoder.ids(text):
        rest += part
        full = max(0, (len(rest) - 1) // size) if rest else 0  # the end id is still to come
        for k in range(full):
            yield rest[k * size:(k + 1) * size]
        rest = rest[full * size:]
    rest += np.array([END], "<u4").tobytes()
    for lo in range(0, len(rest), size):
        yield rest[lo:lo + size]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    short_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = block_encoder(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows: list[tuple] = []

            def batch() -> pa.RecordBatch:
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(r[5], "<i4") for r in rows], pa.list_(pa.int32())))
                return pa.RecordBatch.from_arrays(columns, names)

            for doc, text in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                start = 0
                for k, ids in enumerate(cut(encoder, text, capacity)):
                    rows.append((doc, k, start, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                    start += len(ids) // 4
                    if len(rows) >= 1024:
                        yield batch()
                        rows.clear()
            if rows:
                yield batch()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence number and offset of each piece, placed in the given order."""
    twice = np.zeros(capacity + 1, np.int64)  # twice the open sequences per gap
    twice[0] = -1  # closing a sequence adds no square
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = 0
    for i, s in enumerate(lengths.tolist()):
        gaps = twice[s:capacity]
        change = np.where(gaps > 0, twice[:capacity - s] - gaps + 2, np.iinfo(np.int64).max) if len(gaps) else gaps
        k = int(change.argmin()) if len(gaps) else 0
        if not len(gaps) or change[k] > (twice[capacity - s] + 1 if s < capacity else 0):
            own, gap, n = n, capacity, n + 1
        else:
            gap = s + k
            own = open_at[gap].pop()
            twice[gap] -= 2
        sequence[i], offset[i] = own, capacity - gap
        if gap > s:
            open_at[gap - s].append(own)
            twice[gap - s] += 2
    return sequence, offset


def placed(rows: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` of pieces, a written table, with sequence_id and offset."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"

    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        sequence, offset = sum_of_squares(shard["length"].to_numpy(), capacity)
        shard["sequence_id"] = (np.int64(shard["shard"].iloc[0]) << 32) + sequence
        shard["offset"] = offset
        return shard.drop(columns="shard")

    # equal shards whatever the ids: pieces are numbered over slices of a range, and copies told apart by their place
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("_at")]
    numbered = rank_within(rows.withColumn("_at", F.monotonically_increasing_id()), [], order, "_number").drop("_at")
    dealt = numbered.withColumn("shard", F.pmod("_number", F.lit(shards))).drop("_number")
    return dealt.groupBy("shard").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                   shard: int = SHARD) -> DataFrame:
    """Every piece of every document with its place."""
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    shards = -(-(size["n"] + (size["b"] or 0) // (4 * capacity)) // shard) or 1
    return placed(materialize(pieces(docs, tokenizer, capacity)), shards, capacity)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, with one row per sequence of at most ``capacity`` ids."""
    places = pack_documents(docs, tokenizer, capacity).drop("start", "length")
    rows = pieces(docs, tokenizer, capacity, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").distinct()
    both = places.alias("p").join(rows.alias("r"), F.col("p.doc_id").eqNullSafe(F.col("r.doc_id"))
                                  & (F.col("p.piece") == F.col("r.piece"))
                                  & (F.col("p.ids_crc32") == F.col("r.ids_crc32")))
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(table(spark, sf, "documents"))
