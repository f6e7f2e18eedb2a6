"""Packing: token ids against the tokenizer, places against the definition, waste against a lower bound."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from lakefind.llm import packing as P
from llm_cases import HAVE_TABLES, SF, documents, odd_rows, words

ODD = ["<|endoftext|> a<|endoftext|>b ISN'T it's 'tis don't \x1c a\x85b\xa0x İstanbul ΑΣ. ½ ² 12.5 ǅ é ́a \x01 \x00",
       "", " \n\t\r ", ". . .!!??", "ß ẞ ﬁ 한국어 日本 123abc abc123 #$%&&& Was!!", words(3, 3000), "x" * 5000]


def ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check_places(rows, capacity):
    """Sequences are gapless from 0 and within capacity."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_block_ids_are_the_tokenizers_ids(monkeypatch):
    encoder = P.BlockEncoder(P.default_tokenizer())
    want = [ids(encoder.tokenizer, t) for t in ODD]
    for segment in (P.SEGMENT, 7):
        monkeypatch.setattr(P, "SEGMENT", segment)
        got = [np.frombuffer(b"".join(P.cut(encoder, t, 16)), "<u4").tolist() for t in ODD]
        assert got == want
    assert [len(p) // 4 for p in P.cut(encoder, "a " * 2047, 2048)] == [2048]
    assert [len(p) // 4 for p in P.cut(encoder, "a " * 2048, 2048)] == [2048, 1]


def test_blocks_are_forgotten_in_generations(monkeypatch):
    encoder = P.BlockEncoder(P.default_tokenizer())
    text = " ".join([words(k, 40) + " the, of. " + words(k % 3, 9) for k in range(30)])
    want = ids(encoder.tokenizer, text)
    monkeypatch.setattr(P, "CACHE", 20)
    monkeypatch.setattr(P, "SEGMENT", 90)
    assert np.frombuffer(b"".join(P.cut(encoder, text, 16)), "<u4").tolist() == want
    assert max(map(len, (encoder.known, encoder.old_known, encoder.runs, encoder.old_runs))) < 120
    encoder.forget()
    assert not encoder.known and not encoder.old_runs


@pytest.mark.parametrize("doc", [None, 7])
def test_one_id_for_a_third_of_all_rows_fills_all_shards_alike(spark, doc):
    rows = [(k if k % 3 else doc, words(k % 3, 12 + k % 5)) for k in range(300)]
    got = P.pack_documents(documents(spark, rows), capacity=64, shard=50).collect()
    assert len(got) >= 300
    shards = defaultdict(int)
    for r in got:
        shards[r["sequence_id"] >> 32] += 1
    assert len(shards) > 5 and max(shards.values()) - min(shards.values()) <= 1
    check_places(got, 64)


def test_pieces_and_places_of_odd_rows(spark):
    rows = odd_rows()
    tokenizer = P.BlockEncoder(P.default_tokenizer()).tokenizer
    got = P.pack_documents(documents(spark, rows), capacity=64).collect()
    want = []
    for doc, text in rows:
        own = ids(tokenizer, text)
        for k, lo in enumerate(range(0, len(own), 64)):
            part = np.array(own[lo:lo + 64], "<u4")
            want.append((doc, k, lo, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got))) == sorted(
        map(repr, want))
    check_places(got, 64)


@pytest.mark.skipif(not HAVE_TABLES, reason="no test tables")
def test_given_documents_take_few_sequences(spark):
    got = P.pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    least = -(-sum(r["length"] for r in got) // P.CAPACITY)
    assert check_places(got, P.CAPACITY) <= 1.03 * least + 2


def test_sequences_hold_the_ids_in_place(spark):
    rows = [(k, words(k, 30 + 9 * k)) for k in range(12)]
    docs = documents(spark, rows)
    tokenizer = P.BlockEncoder(P.default_tokenizer()).tokenizer
    places = P.pack_documents(docs, capacity=256).collect()
    packed = {r["sequence_id"]: r["ids"] for r in P.sequences(docs, capacity=256).collect()}
    for r in places:
        own = ids(tokenizer, dict(rows)[r["doc_id"]])[r["start"]:r["start"] + r["length"]]
        assert packed[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == own
    assert sum(map(len, packed.values())) == sum(r["length"] for r in places)


def test_each_piece_goes_where_the_squares_become_smallest():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 33, 300)
    sequence, offset = P.sum_of_squares(lengths, 32)
    used = defaultdict(int)
    for s, own, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist(), strict=True):
        gaps = [32 - u for u in used.values() if u < 32]
        squares = lambda g: sum(n * n for n in np.bincount(g, minlength=33)[1:].tolist()) if g else 0

        def after(gap, gaps=gaps, s=s):
            left = list(gaps)
            if gap < 32:
                left.remove(gap)
            return squares(left + [gap - s] * (gap > s))

        options = {g: after(g) for g in {*gaps, 32} if g >= s}
        assert options[32 - used[own]] == min(options.values()) and at == used[own]
        used[own] += s


def test_empty_table(spark):
    assert P.pack_documents(documents(spark, [])).count() == 0
