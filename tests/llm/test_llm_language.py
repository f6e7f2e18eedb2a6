"""Language ID: counts and distances against direct versions, accuracy on held-out rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from lakefind.llm import language as L
from llm_cases import HAVE_TABLES, SF, documents, odd_rows
from lakefind.plans.registry import QUERIES


def direct_grams(text):
    """N-grams of one to three letters or blanks, as strings."""
    plain = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    if not plain.strip():
        return Counter()
    s = " " + plain
    s = " " + " ".join(s.split(" ")).strip() + " "
    s = " ".join(x for x in s.split(" ") if x)
    s = f" {s} "
    out = Counter(c for c in s if c != " ")
    out.update(s[i:i + 2] for i in range(len(s) - 1))
    out.update(s[i:i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
    return out


def code(gram):
    """The number of an n-gram."""
    value = 0
    for c in gram:
        value = value << 21 | (0 if c == " " else ord(c))
    return value | (1 << 63 if len(gram) == 2 else 0)


@pytest.mark.parametrize("text", ["Hello, hello world", "a", "  é1Ü ", "x-y z", "İstanbul ÀÉ 漢字", "a" * 50, "ab\ncd  ef!"])
def test_counts_match_a_direct_version(text):
    grams, counts = L.Grams().count(text)
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in direct_grams(text).items()}


def test_long_text_in_pieces(monkeypatch):
    text = "lorem ipsum " * 400
    whole = L.Grams().count(text)
    monkeypatch.setattr(L, "PIECE", 120)  # pieces that end at a blank
    parts = L.Grams().count(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_out_of_place_distance():
    found = L.Profiles({"x": np.array([1, 2, 3], np.uint64), "y": np.array([3, 4], np.uint64)}, size=10)
    # x: 3 is 2 places off, 1 is 1 off, 9 is missing; y: 3 is in place, the others are missing
    assert found.best(np.array([3, 1, 9], np.uint64)) == ("x", pytest.approx(1 - (2 + 1 + 10) / 30))
    assert found.best(np.zeros(0, np.uint64)) == (L.UNKNOWN, 0.0)


def test_odd_rows_and_columns(spark):
    docs = documents(spark, odd_rows())
    profiles = L.learn_profiles(docs.unionByName(documents(spark, [(70, "zz yy zz"), (71, "zz")], "q")).unionByName(
        documents(spark, [(72, "never learned")], None)))
    assert set(profiles) == {"en", "q"} and all(len(p) <= L.SIZE for p in profiles.values())
    out = L.identify(docs, profiles).select("row.doc_id", "lang_pred", "score").collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert {(r["lang_pred"], r["score"]) for r in out if r["doc_id"] in (2, 3, 4)} == {(L.UNKNOWN, 0.0)}
    assert {r["lang_pred"] for r in L.identify(docs, {}).collect()} == {L.UNKNOWN}
    assert L.identify(documents(spark, []), L.learn_profiles(documents(spark, []))).count() == 0


@pytest.mark.skipif(not HAVE_TABLES, reason="no test tables")
def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op1_language_id"](spark, SF).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
