"""Centroid clustering: every round against a direct version on Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from lakefind.llm import centroids as C


def brute(rows, k=8, rounds=10, dim=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [[] for _ in cents]
        for _, v in kept:
            own[near(v)[1]].append(v)
        cents = [[sum(col) // len(vs) for col in zip(*vs)] if vs else c for vs, c in zip(own, cents)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    total = [sum(d for _, c, d in got if c == j) for j in range(len(cents))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, total[c], sum(total), names[c]) for i, c, d in got), key=repr)


def frame(spark, rows, kind="float"):
    full = [(i, v, "x", 1) for i, v in rows]
    return spark.createDataFrame(full, f"vec_id bigint, embedding array<{kind}>, cluster string, distance int")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(seed, n, dim=64):
    rng = random.Random(seed)
    return [[float(np.float32(rng.gauss(0, 0.2))) for _ in range(dim)] for _ in range(n)]


@pytest.mark.parametrize("block", [3, 4096])
def test_rounds_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    base = vectors(1, 40)
    bad = [None, [], base[0][:63], base[0] + [0.5], [None] + base[0][1:], [float("nan")] + base[0][1:],
           base[0][:63] + [float("-inf")]]
    rows = [*enumerate(base), *[(100 + k, v) for k, v in enumerate(bad)], (None, base[3]), (None, base[4]), (5, base[5]),
            (5, base[5]), (6, base[7])]
    assert result(C.cluster_vectors(frame(spark, rows))) == brute(rows)


def test_ties_copies_and_few_vectors(spark):
    same = [(k, [0.25] * 64) for k in range(30)]  # all centroids equal: everything goes to number 0
    got = result(C.cluster_vectors(frame(spark, same)))
    assert got == brute(same) and {r[1] for r in got} == {0}
    few = [(k, v) for k, v in enumerate(vectors(2, 3))]
    assert result(C.cluster_vectors(frame(spark, few))) == brute(few)
    assert C.cluster_vectors(frame(spark, [(1, None)])).count() == 0
    assert C.cluster_vectors(frame(spark, [])).columns[0] == "vec_id"


def test_negative_and_wide_integers(spark):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-131_000, 131_000) for _ in range(64)]) for k in range(30)]
    assert result(C.cluster_vectors(frame(spark, rows, "double"))) == brute(rows)
    with pytest.raises(Exception, match="beyond"):
        C.cluster_vectors(frame(spark, [(1, [131_072.0] * 64)], "double")).collect()


def test_tables_are_the_squared_differences():
    rows = np.array([[k % 5 - 2 + d for d in range(4)] for k in range(20)])
    block = C.Coded.read(*C.Coded.of(rows).written())
    cents = np.array([[0, 1, 2, 3], [-7, 0, 9, 1]])
    assert (block.distances(cents) == ((rows[:, None] - cents[None]) ** 2).sum(2)).all()
    cluster = np.arange(20) % 2
    assert (block.sums(cluster, 2) == [rows[cluster == c].sum(0) for c in (0, 1)]).all()
