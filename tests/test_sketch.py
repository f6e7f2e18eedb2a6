"""Sketches against exact overlap."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefind.operators import overlap as O
from lakefind.operators import sketch as S

SETS = "table_id string, col_idx int, value string"
PAIRS = "query_table string, query_col int, cand_table string, cand_col int"


def sets(spark, **columns):
    return spark.createDataFrame([(t, 0, str(v)) for t, values in columns.items() for v in values], SETS)


def test_signature_formula(spark):
    values = [f"v{i}" for i in range(57)]
    sig = S.minhash(sets(spark, a=values).repartition(6), 16).first().sig
    a, b = S.permutations(16)
    hashes = [int(hashlib.md5(v.encode()).hexdigest()[:15], 16) for v in values]
    assert sig == [min((int(x) * h + int(y)) % S.PRIME for h in hashes) for x, y in zip(a, b)]


def test_estimates(spark):
    df = sets(spark, q=range(500), same=range(500), half=range(250, 750), other=range(1000, 1400), big=range(5000))
    sigs = S.minhash(df, 256)
    pairs = spark.createDataFrame([("q", 0, c, 0) for c in ("same", "half", "other", "big", "gone")], PAIRS)
    got = {r.cand_table: r for r in S.estimate(sigs, pairs).collect()}
    assert got["same"].jaccard == 1.0 and got["same"].containment == 1.0
    assert got["half"].jaccard == pytest.approx(1 / 3, abs=0.1) and got["half"].containment == pytest.approx(0.5, abs=0.12)
    assert got["half"].union_size == pytest.approx(750, rel=0.2)
    assert got["other"].jaccard < 0.02 and got["gone"].containment is None
    assert got["big"].containment == pytest.approx(1, abs=0.25)


def test_filter_recall_and_precision(spark):
    rng = np.random.default_rng(1)
    columns, pairs = {}, []
    for q in range(12):
        base = [f"q{q}_{i}" for i in range(int(rng.integers(40, 400)))]
        columns[f"q{q}"] = base
        for c in range(30):
            share = float(rng.choice([0.0, 0.05, 0.1, 0.9, 1.0]))
            extra = [f"c{q}_{c}_{i}" for i in range(int(rng.integers(0, 200)))]
            columns[f"c{q}_{c}"] = base[: int(round(share * len(base)))] + extra + ["shared"]
            pairs.append((f"q{q}", 0, f"c{q}_{c}", 0))
    df = sets(spark, **columns).cache()
    candidates = spark.createDataFrame(pairs, PAIRS)
    exact = {(r.query_table, r.cand_table): r.containment for r in O.containment(df, candidates).collect()}
    kept = {(r.query_table, r.cand_table) for r in S.containment_filter(
        S.minhash(df, 128), O.set_sizes(df), candidates, 0.5, num_part=4).collect()}
    good = {p for p, c in exact.items() if c >= 0.5}
    assert len(good & kept) / len(good) > 0.9
    assert len(good & kept) / len(kept) > 0.7
    verified = {(r.query_table, r.cand_table) for r in S.verified_filter(df, candidates, 0.5, num_part=4).collect()}
    assert verified == good & kept


def test_band_choice_moves_with_the_threshold():
    b_low, r_low = S._band_choice(1.0, 0.2, 128)
    b_high, r_high = S._band_choice(1.0, 0.9, 128)
    assert b_low * r_low <= 128 and b_high * r_high <= 128 and r_high > r_low


def test_rerank(spark):
    candidates = spark.createDataFrame(
        [("q", 0, c, 0, i + 1) for i, c in enumerate("abcd")], PAIRS + ", rank int")
    estimates = spark.createDataFrame([("q", 0, "a", 0, 0.1), ("q", 0, "b", 0, 0.7), ("q", 0, "c", 0, 0.7)],
                                      PAIRS + ", containment double")
    ranked = S.rerank(candidates, estimates).orderBy("rank").select("cand_table").collect()
    assert [r.cand_table for r in ranked] == ["b", "c", "a", "d"]


def test_value_sets_skip_missing(spark):
    cells = spark.createDataFrame([("t", 0, 0, "a", "x"), ("t", 1, 0, "a", "x"), ("t", 2, 0, "a", None)],
                                  "table_id string, row_idx long, col_idx int, col_name string, value string")
    assert [r.value for r in O.value_sets(cells).collect()] == ["x"]
    assert O.set_sizes(O.value_sets(cells)).first().n_distinct == 1
    assert O.value_sets(cells).filter(F.col("value").isNull()).isEmpty()


def test_containment_pairs_whatever_the_sizes(spark):
    rng = np.random.default_rng(5)
    columns = {"big": range(20000), "mid": range(3000, 3900), "flag": ["0", "1", "x", "y"], "copy": range(3000, 3900)}
    for i, n in enumerate(rng.integers(1, 600, 40)):
        inside = int(round(n * float(rng.choice([0.3, 0.5, 0.7, 1.0]))))
        columns[f"q{i}"] = [*rng.choice(20000, inside, replace=False), *[f"own{i}_{k}" for k in range(n - inside)]]
    df = sets(spark, **columns).cache()
    held = {t: {str(v) for v in values} for t, values in columns.items()}
    want = {(q, c): len(held[q] & held[c]) / len(held[q]) for q in held for c in held if q != c}
    want = {pair: share for pair, share in want.items() if share >= 0.5}
    got = {(r.query_table, r.cand_table): r.containment for r in S.containment_pairs(df, 0.5).collect()}
    assert got == pytest.approx(want) and len(got) > 30
    sigs, sizes = S.minhash(df).cache(), O.set_sizes(df)
    banded = {(r.query_table, r.cand_table) for r in S.banded_pairs(sigs, sizes, 0.5).collect()}
    assert len(banded & set(want)) < 0.5 * len(want)  # what bands alone can find
    found = [(r.query_table, r.cand_table) for r in S.candidate_pairs(df, sigs, 0.5).collect()]
    assert len(found) == len(set(found)) and len(set(found) & set(want)) >= 0.9 * len(want)
    gap = S.least_gap(0.5)
    while S.band_shape(gap, 0.5, 128):
        gap += 1
    part = {t: int(2 * np.log2(len(v))) for t, v in held.items()}
    far = {p for p in want if part[p[1]] - part[p[0]] >= gap}
    assert {(r.query_table, r.cand_table) for r in S.containment_pairs(df, 0.5, gap).collect()} == far
    assert far <= set(found)


def test_band_index_finds_similar_sizes(spark):
    rng = np.random.default_rng(7)
    columns = {}
    for i in range(60):
        n = int(rng.integers(30, 400))
        columns[f"q{i}"] = [f"{i}_{k}" for k in range(n)]
        share = float(rng.choice([0.2, 0.5, 0.75, 1.0]))
        more = int(n * rng.uniform(0, 0.4))
        columns[f"c{i}"] = columns[f"q{i}"][: int(np.ceil(share * n))] + [f"x{i}_{k}" for k in range(more)]
    df = sets(spark, **columns).cache()
    held = {t: set(v) for t, v in columns.items()}
    part = {t: int(2 * np.log2(len(v))) for t, v in held.items()}
    want = {(q, c) for q in held for c in held if q != c and len(held[q] & held[c]) >= 0.5 * len(held[q])
            and S.band_shape(part[c] - part[q], 0.5, 128)}
    got = {(r.query_table, r.cand_table) for r in S.banded_pairs(S.minhash(df), O.set_sizes(df), 0.5).collect()}
    assert len(want) > 50 and len(got & want) >= 0.95 * len(want)
    assert len(got) < 4 * len(want)


def test_copies_and_long_lists_of_a_band(spark, monkeypatch):
    monkeypatch.setattr(S, "LONG_LIST", 3)
    columns = {f"t{i}": [f"v{k}" for k in range(20 + i % 2)] for i in range(24)}
    columns["near"] = [f"v{k}" for k in range(18)] + ["own"]
    df = sets(spark, **columns).cache()
    got = [(r.query_table, r.cand_table) for r in S.candidate_pairs(df, S.minhash(df), 0.5).collect()]
    assert len(got) == len(set(got)) == 25 * 24


def test_size_parts_and_shapes(spark):
    sizes = [1, 2, 3, 4, 5, 7, 8, 1000, 2**30, 2**31 - 1]
    got = spark.createDataFrame([(n,) for n in sizes], "n bigint").select(S.size_part("n")).collect()
    assert [r[0] for r in got] == [(n * n).bit_length() - 1 for n in sizes]
    assert S.least_gap(0.5) == -2 and S.least_gap(1.0) == 0
    for t in (0.5, 0.8):
        for gap in range(S.least_gap(t), 10):
            if shape := S.band_shape(gap, t, 128):
                b, r = shape
                j = t / (1 + 2 ** ((gap + 1) / 2) - t)
                assert b * r <= 128 and r >= 2 and 1 - (1 - j**r) ** b >= 0.95
    assert S.sampled(0.5) == 128 and S.sampled(0.1) == 1152 and S.sampled(0.9) == 64


@pytest.mark.parametrize("name", ["containment_estimates", "rerank_by_containment"])
def test_signatures_are_made_once(spark, monkeypatch, name):
    import __spark_entry__ as entry
    from lakefind.plans import searching

    made, minhash = [], S.minhash
    rows = [(t, r, 0, "c", f"v{r}") for t, n in (("a", 40), ("b", 50)) for r in range(n)]
    lake = spark.createDataFrame(rows, "table_id string, row_idx long, col_idx int, col_name string, value string")
    monkeypatch.setattr(searching, "cells", lambda *_: lake)
    monkeypatch.setattr(S, "minhash", lambda *a: made.append(1) or minhash(*a))
    got = {(r.query_table, r.cand_table): r.containment for r in entry.queries()[name](spark, "").collect()}
    assert set(got) == {("a", "b"), ("b", "a")} and got["a", "b"] > 0.8
    assert len(made) == 1
