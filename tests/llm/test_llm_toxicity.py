"""The factorization machine: the pair sum, gradients against differences, pairs that weights miss, held-out rows."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from lakefind.llm import toxicity as T
from lakefind.plans.registry import QUERIES
from llm_cases import HAVE_TABLES, documents, odd_rows, words

SF = "/root/testdata/sf0.1"


def case(seed=1, n=30, m=12):
    rng = random.Random(seed)
    machine = T.Machine(np.arange(m), 0.3)
    machine.w["weight"] = np.random.default_rng(seed).normal(0, 1, m)
    rows = [sorted(rng.sample(range(m), rng.randint(0, 6))) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return machine, rows, np.array([t for r in rows for t in r], np.int64), starts, np.array([k % 2 for k in range(n)], float)


def test_scores_are_the_sum_over_all_pairs():
    machine, rows, *_ = case()
    w = machine.w
    want = [w["bias"][0] + sum(w["weight"][i] for i in r) + sum(w["factor"][i] @ w["factor"][j] for i, j in combinations(r, 2))
            for r in rows]
    assert np.allclose(machine.scores(rows), 1 / (1 + np.exp(-np.array(want))))
    assert machine.scores([]).tolist() == [] and machine.scores([[]])[0] == pytest.approx(1 / (1 + np.exp(-0.3)))


def test_gradients_match_differences():
    machine, _, at, starts, y = case(2)

    def loss():
        z = machine.logits(at, starts)[0]
        return np.mean(np.logaddexp(0, z) - y * z) + T.DECAY / 2 * (machine.w["weight"] ** 2).sum() + (
            T.FACTOR_DECAY / 2 * (machine.w["factor"] ** 2).sum())

    grad = {k: v.copy() for k, v in machine.gradients(at, starts, y).items()}
    for name, w in machine.w.items():
        for k in range(min(w.size, 10)):
            old = w.flat[k]
            w.flat[k] = old + 1e-6
            up = loss()
            w.flat[k] = old - 1e-6
            down = loss()
            w.flat[k] = old
            assert (up - down) / 2e-6 == pytest.approx(grad[name].flat[k], rel=1e-4, abs=1e-8)


def pairs(seed, n=900):
    """Toxic only where an insult and a group stand together; either alone, with other words, is clean."""
    rng = random.Random(seed)
    insults, groups = [f"insult{k}" for k in range(4)], [f"group{k}" for k in range(4)]
    out = []
    for _ in range(n):
        text = [words(rng.randrange(10**6), 1) for _ in range(8)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text += [rng.choice(insults)] * a + [rng.choice(groups)] * b
        rng.shuffle(text)
        out.append((" ".join(text), int(a and b)))
    return out


def accuracy(train, test):
    terms = T.Terms()
    machine = T.fit([np.array(terms.of(t)) for t, _ in train], [y for _, y in train])
    known = T.Terms({int(b): k for k, b in enumerate(machine.buckets)})
    scores = machine.scores([known.of(t) for t, _ in test])
    return np.mean([(s >= 0.5) == bool(y) for s, (_, y) in zip(scores, test, strict=True)])


def test_pairs_of_harmless_words_are_learned(monkeypatch):
    assert accuracy(pairs(1), pairs(2)) >= 0.99
    # either-or: the parts say nothing that a sum of weights could use
    odd = [(t, int(("insult" in t) != ("group" in t))) for t, _ in pairs(3)]
    monkeypatch.setattr(T, "LEAST_RATIO", 0.0)
    monkeypatch.setattr(T, "LEAST_ROWS", 40)
    full = accuracy(odd, [(t, int(("insult" in t) != ("group" in t))) for t, _ in pairs(4)])
    monkeypatch.setattr(T, "FACTOR_DECAY", 1e3)  # no factors: weights alone
    plain = accuracy(odd, [(t, int(("insult" in t) != ("group" in t))) for t, _ in pairs(4)])
    assert full >= 0.95 and plain <= 0.85


def test_words_stems_and_whole_texts():
    assert len(T.buckets_of("abcdefghi")) == 1 + len(T.STEMS) and len(T.buckets_of("ab")) == 1
    assert set(T.buckets_of("worthlessly")) & set(T.buckets_of("worthlessness"))
    terms = T.Terms()
    assert terms.of("A a  B,b!") == sorted({*T.buckets_of("a"), *T.buckets_of("b")})
    long = words(4, 60_000)
    assert set(T.buckets_of("idiot")) <= set(terms.of(long + " Idiot")) and terms.of("") == []
    small = T.Terms()
    assert small.of("x") == T.buckets_of("x") and T.Terms({}).of(long) == []


def test_odd_rows_and_labels(spark):
    rows = odd_rows() + [(100 + k, words(k, 9) + (" idiot" if k % 4 == 0 else "")) for k in range(80)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame(
        [(100 + k, 1, int(k % 4 == 0)) for k in range(80)] + [(100, 0, 0), (3, 1, None), (None, 1, 1), (7777, 1, 1)],
        "doc_id bigint, quality int, toxic int")
    machine = T.fit_sample(docs, labels)
    assert set(machine.buckets) >= set(T.buckets_of("idiot"))
    out = T.toxicity_scores(docs, machine).select("row.doc_id", "score", "predicted").collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (2, 3, 4)}) == 1
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in out if (r["doc_id"] or 0) >= 100)
    far = T.toxicity_scores(documents(spark, [(1, words(9, 30_000) + " idiot"), (2, words(9, 30_000))]), machine)
    assert [r["predicted"] for r in far.orderBy("row.doc_id").collect()] == [1, 0]
    assert T.toxicity_scores(docs.limit(0), machine).count() == 0
    none = T.fit_sample(docs, labels.limit(0))
    assert {r["score"] for r in T.toxicity_scores(docs, none).collect()} == {0.5}
    assert T.fit([np.array([1])] * 2, [1, 1]).scores([[]])[0] == pytest.approx(1, abs=1e-4)


@pytest.mark.skipif(not HAVE_TABLES, reason="no test tables")
def test_held_out_rows(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op11_toxicity"](spark, SF).collect()
    assert len(got) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in toxic]
    caught, clean = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert sum(caught) >= 0.85 * len(caught) and sum(clean) <= 0.01 * len(clean)
