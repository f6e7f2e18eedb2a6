"""The n-gram Jaccard join against all pairs."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from lakefind.llm import jaccard_join as J
from lakefind.llm.components import components
from llm_cases import HAVE_TABLES, SF, documents, odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{(id, set size, component id)} by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    pairs = {p for own in lists.values() for p in combinations(own, 2)}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            up[root(j)] = root(i)
    names = defaultdict(list)
    for i in range(len(rows)):
        names[root(i)].append(rows[i][0])
    out = []
    for i, (doc, _) in enumerate(rows):
        known = [n for n in names[root(i)] if n is not None]
        out.append((doc, len(sets[i]), (min(known) if known else None) if sets[i] else doc))
    return sorted(map(repr, out))


def near_copies(seed, n, size, first):
    """A text and edited copies of it, from barely to heavily changed."""
    rng, base = random.Random(seed), words(seed, size).split()
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 500)}"
        out.append((first + k, " ".join(copy)))
    return out


def test_matches_all_pairs_with_odd_rows_and_groups_of_copies(spark):
    rows = odd_rows() + near_copies(11, 60, 120, 100) + near_copies(12, 25, 30, 300)
    rows += [(500 + k, f"{words(77, 50)} {words(k, 40)}") for k in range(12)]  # a shared passage, no near copies
    rows += [(600 + k, words(99, 33).upper()) for k in range(30)] + [(None, words(99, 33))]
    got = sorted(repr(tuple(r)) for r in J.similarity_components(documents(spark, rows)).collect())
    assert got == brute(rows)


@pytest.mark.skipif(not HAVE_TABLES, reason="no test tables")
def test_matches_all_pairs_on_the_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in J.similarity_components(docs).collect()) == brute(rows)


def test_one_of_each_keeps_the_smallest_id_and_all_columns(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    out = J.one_of_each(docs)
    assert out.columns == docs.columns
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert kept == [(False, k) for k in (1, 2, 3, 4, 6, 6, 7, 8, 10)] + [(True, 0)]


def test_links_through_rows_without_an_id(spark):
    """A and C are linked by N alone, whatever N's id is."""
    base = words(21, 104).split()
    a, c = list(base), list(base)
    a[5:8], c[60:63] = ["edit1", "edit2", "edit3"], ["edit4", "edit5", "edit6"]
    texts = [" ".join(x) for x in (a, base, c)]

    def alike(x, y):
        x, y = shingles(x), shingles(y)
        return len(x & y) / len(x | y)

    assert alike(texts[0], texts[1]) >= 0.8 and alike(texts[1], texts[2]) >= 0.8 > alike(texts[0], texts[2])
    rows = [(1, texts[0]), (None, texts[1]), (None, texts[1]), (9, texts[2]), (None, words(3, 20)), (None, words(4, 20))]
    assert sorted(repr(tuple(r)) for r in J.similarity_components(documents(spark, rows)).collect()) == brute(rows)


def test_one_of_each_drops_repeated_rows(spark):
    rows = [(2, words(8, 30))] * 3 + [(None, words(9, 30))] * 2 + [(3, "")] * 2 + [(4, None), (None, None), (None, None)]
    rows += [(6, words(10, 50)), (6, words(10, 50) + " end")]  # one id, two texts that are near copies
    out = [(r["doc_id"], r["text"]) for r in J.one_of_each(documents(spark, rows)).collect()]
    assert len(out) == len(set(out)) and {d for d, _ in out} == {2, 3, 4, 6, None}
    assert sorted(map(repr, (r for r in out if r[0] is None))) == sorted(map(repr, [(None, None), (None, words(9, 30))]))
    assert sum(d == 6 for d, _ in out) == 1


def test_a_third_of_all_rows_without_an_id(spark):
    doc = None
    copies = near_copies(31, 40, 60, 0)
    rows = [(doc if k % 3 == 0 else 100 + k, t) for k, (_, t) in enumerate(copies)]
    rows += [(doc, words(500 + k, 12)) for k in range(20)]
    assert sorted(repr(tuple(r)) for r in J.similarity_components(documents(spark, rows)).collect()) == brute(rows)


def test_long_lists_are_dealt_over_slices(spark, monkeypatch):
    monkeypatch.setattr(J, "LONG_LIST", 1)
    rows = near_copies(41, 50, 80, 0) + [(100 + k, f"{words(77, 30)} {words(k, 60)}") for k in range(25)]
    rows += near_copies(42, 10, 40, 200)
    docs = documents(spark, rows)
    assert sorted(repr(tuple(r)) for r in J.similarity_components(docs).collect()) == brute(rows)
    bits = J.sketch_bits(len(rows))
    lists = J.shared_postings(J.postings(docs, J.sketch_levels(J.measured(docs, bits), bits), bits)).collect()
    assert any(r["long"] for r in lists)
    own = defaultdict(list)
    for r in lists:
        own[r["tok"]].append(r)
    for of_tok in own.values():
        assert len({r["cls"] for r in of_tok}) == len(of_tok) > 1
        top = max((r["typ"], r["cls"]) for r in of_tok)
        assert {(r["lead"]["typ"], r["lead"]["cls"]) for r in of_tok} == {top}


def test_empty_table(spark):
    assert J.similarity_components(documents(spark, [])).count() == 0


def test_prefixes_hold_the_required_matches():
    """Two similar sets share at least the smaller number of matches within both prefixes, for any levels."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, edits = int(rng.integers(3, 80)), int(rng.integers(0, 8))
        base = rng.permutation(10_000)[:n + edits].astype(np.uint64)
        x, y = np.sort(base[:n]), np.sort(base[edits:])
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        level = rng.integers(0, 12, 10_000).astype(np.uint8)
        found = []
        for s in (x, y):
            order = np.argsort(level[s.astype(int)], kind="stable")
            m = J.matches(level[s.astype(int)][order], len(s), 1.0)
            found.append((s[order], m, len(s)))
        need = min(found[0][1], found[1][1])
        overlap = -(-80 * (len(x) + len(y)) // 180)
        parts = [set(s[:n_ - overlap + need].tolist()) for s, _, n_ in found]
        assert len(parts[0] & parts[1]) >= need


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(1000, 1000 + k) for k in range(1, 30)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (3, 2), (2000, 2001), (2001, 2000)], "a bigint, b bigint")
    labels = {r["node"]: r["label"] for r in components(edges).collect()}
    groups = defaultdict(set)
    for node, label in labels.items():
        groups[label].add(node)
    assert sorted(map(len, groups.values())) == [2, 30, 41]
    assert components(edges.where("a < 0")).count() == 0


def test_mean_count_of_a_sketch():
    levels = np.random.default_rng(3).integers(0, 40, 1 << 16).astype(np.uint8)
    assert np.isclose(J.mean_count(levels), np.mean(np.exp2(levels / 2.0) - 1))
