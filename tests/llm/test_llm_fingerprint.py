"""Fingerprints: digests against the definition, neighbours against a sorted list."""

import hashlib

import numpy as np
import pytest
import xxhash

from lakefind.llm import fingerprint as D
from lakefind.plans.registry import QUERIES
from llm_cases import HAVE_TABLES, SF, documents, odd_rows, words


def test_counts_match_the_definition(monkeypatch):
    data = words(1, 80).encode()
    total = np.zeros(D.BUCKETS, int)
    for at in range(len(data) - 4):
        w = data[at:at + 5]
        for (i, j, k), (a, b, c) in zip(D.TRIPLETS, D.TABLES, strict=True):
            total[c[b[a[w[i]] ^ w[j]] ^ w[k]]] += 1
    assert (D.bucket_counts(data) == total).all()
    monkeypatch.setattr(D, "PIECE", 37)
    assert (D.bucket_counts(data) == total).all()


def test_digests_and_likeness():
    text = words(2, 300)
    near, far = text[:-40] + words(3, 8), words(4, 300)
    own = D.digest(text)
    assert D.digest(text) == own and len(own) == 2 * (2 + D.BUCKETS // 4)
    assert D.likeness(own, own) == 1.0
    assert 0 <= D.likeness(own, D.digest(far)) < D.likeness(own, D.digest(near)) < 1
    assert D.likeness(D.digest(""), D.digest("")) == 1.0 and D.likeness(D.digest(""), own) == 0.0
    assert D.difference(own, D.digest(near)) == D.difference(D.digest(near), own)
    assert all(0 <= D.likeness(D.digest(a), D.digest(b)) <= 1 for a in ("a", "é", "x" * 99) for b in ("b", text))


def text_hash(text):
    """Spark's 64-bit hash of a text, as it orders rows that share an id."""
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (h >> 63 << 64)


def direct(rows):
    full = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]), r[1].encode()))
    return [D.edit_report(i, t, full[(k + 1) % len(full)][1]) for k, (i, t) in enumerate(full)]


def test_neighbours_over_slices_match_a_sorted_list(spark):
    rows = odd_rows() + [(1000 + 7 * k, words(k, 5 + k % 9)) for k in range(60)]
    got = D.neighbours(documents(spark, rows), D.edit_report, D.EDIT_SCHEMA).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, direct(rows)))
    one = D.neighbours(documents(spark, rows[:1]), D.edit_report, D.EDIT_SCHEMA).collect()
    assert [tuple(r) for r in one] == direct(rows[:1])
    assert D.neighbours(documents(spark, []), D.edit_report, D.EDIT_SCHEMA).count() == 0
    plain = {r["doc_id"]: r["fingerprint"] for r in D.fingerprints(documents(spark, rows[-5:])).collect()}
    assert plain == {i: D.digest(t) for i, t in rows[-5:]}


def test_edit():
    assert D.edited("abcdefgh", "xyz") == "abcdefxy" and D.edited("abcdefgh", "x") == "abcdefx"
    assert D.edited("abc", "xyz") == "abc" and D.edited("", "x") == ""


@pytest.mark.skipif(not HAVE_TABLES, reason="no test tables")
def test_edited_texts_are_nearer_than_other_texts(spark):
    got = QUERIES["op8_document_fingerprints"](spark, SF).collect()
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, got)) == sorted(direct(docs))
    assert len({hashlib.sha256(t.encode()).hexdigest() for _, t in docs}) >= len({r["fingerprint"] for r in got})
    sure = [r for r in got if r["n_chars"] >= 200]
    assert sum(r["near_edited"] > r["near_next"] for r in sure) >= 0.97 * len(sure)
