"""Decontamination against all windows of all documents."""

from collections import Counter

import numpy as np
import pytest

from lakefind.llm import decontaminate as C
from lakefind.llm.common import words_of
from llm_cases import HAVE_TABLES, SF, documents, odd_rows, words


def shingles(w):
    return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(docs, items):
    """{(doc_id, item_id): best similarity} over every window of item size."""
    found = {}
    for doc, text in docs:
        w = words_of(text or "")
        for item, other in items:
            v = words_of(other or "")
            if not w or not v:
                continue
            b = Counter(shingles(v))
            for k in range(max(1, len(w) - len(v) + 1)):
                a = Counter(shingles(w[k:k + len(v)]))
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= C.SIMILARITY:
                    found[doc, item] = max(s, found.get((doc, item), 0))
    return found


def cases():
    items = [(1, words(500, 30)), (2, words(501, 40)), (3, None), (4, ""), (5, "just three words"), (6, words(500, 30)),
             (7, " ".join(["again again stop"] * 9)), (None, words(502, 20))]
    edited = words(501, 40).split()
    edited[38] = "changed"  # two shingles less
    docs = [row for row in odd_rows() if row[0] != 7] + [
        (20, f"{words(9, 50)} {words(500, 30).upper()}\n{words(10, 20)}"), (21, " ".join(edited)),
        (22, words(501, 40).rsplit(" ", 1)[0]), (23, f"{words(500, 15)} {words(8, 30)}"), (24, "JUST  three\nwords here"),
        (25, " ".join(["again again stop"] * 12)), (26, words(502, 20)), (26, words(502, 20))]
    return docs, items


def test_matches_all_windows(spark):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in C.contamination(documents(spark, docs), bench).collect()}
    want = brute(docs, items)
    assert got.keys() == want.keys() and {(20, 1), (20, 6), (21, 2), (22, 2), (24, 5), (26, None)} <= got.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.skipif(not HAVE_TABLES, reason="no test tables")
def test_matches_all_windows_of_the_given_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    small = docs.where("n_chars < 800")
    got = {(r["doc_id"], r["item_id"]) for r in C.contamination(small, bench).collect()}
    assert got == brute([tuple(r) for r in small.select("doc_id", "text").collect()],
                        [tuple(r) for r in bench.select("item_id", "text").collect()]).keys()


def test_several_passes_give_the_same_rows(spark, monkeypatch):
    docs, items = cases()
    bench, frame = spark.createDataFrame(items, "item_id bigint, text string"), documents(spark, docs[10:])
    once = sorted(map(repr, C.contamination(frame, bench).collect()))
    monkeypatch.setattr(C, "MAX_CHARS", 400)
    assert sorted(map(repr, C.contamination(frame, bench).collect())) == once


def test_clean_documents_and_empty_tables(spark):
    docs, items = cases()
    bench, frame = spark.createDataFrame(items, "item_id bigint, text string"), documents(spark, docs)
    out = C.clean_documents(frame, bench)
    assert out.columns == frame.columns
    assert {r["doc_id"] for r in out.collect()} == {d for d, _ in docs} - {d for d, _ in brute(docs, items)}
    assert C.contamination(frame.limit(0), bench).count() == 0
    assert C.contamination(frame.where("doc_id = 20"), bench.limit(0)).count() == 0


def test_fingerprints_of_near_windows_are_near():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 60).astype(np.uint64)
    y = x.copy()
    y[:6] = rng.integers(0, 2**63, 6).astype(np.uint64)
    far = lambda a, b: sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(a, b, strict=True))
    assert far(C.fingerprint(x), C.fingerprint(x[::-1].copy())) == 0 and C.similarity(x, x) == 1.0
    assert C.similarity(x, y) >= 0.8 and far(C.fingerprint(x), C.fingerprint(y)) <= C.RADIUS
