"""The quality network: gradients against differences, accuracy on held-out rows."""

import zlib

import numpy as np
import pytest

from lakefind.llm import quality as Q
from lakefind.plans.registry import QUERIES
from llm_cases import HAVE_TABLES, documents, odd_rows, words

SF = "/root/testdata/sf0.01"


def loss(net, docs, labels):
    z = net.head(np.array([net.pooled(net.chunks(d)[0]) for d in docs]))[1]
    return float(np.mean(np.logaddexp(0, z) - labels * z))


def test_gradients_match_differences():
    net = Q.ByteNet(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    docs, y = [net.blocks(t.encode()) for t in ("short", words(1, 300), "!!! ??? " * 60)], np.array([1.0, 0, 1])
    grad = net.gradients(docs, y)
    rng = np.random.default_rng(0)
    for name, w in net.w.items():
        spots = np.argsort(-np.abs(grad[name]).ravel())[:5].tolist() + rng.integers(0, w.size, 3).tolist()
        for k in spots:
            old = w.flat[k]
            w.flat[k] = old + 1e-6
            up = loss(net, docs, y)
            w.flat[k] = old - 1e-6
            down = loss(net, docs, y)
            w.flat[k] = old
            assert (up - down) / 2e-6 == pytest.approx(grad[name].flat[k], rel=2e-2, abs=2e-6)


def test_chunks_cover_the_whole_text(monkeypatch):
    net = Q.ByteNet(1)
    blocks = net.blocks(words(5, 4000).encode())
    top = net.chunks(blocks)[0].max(0)
    spans = np.stack([net.w["embed"][blocks[i:i + Q.BLOCKS]].reshape(-1) for i in range(len(blocks) - Q.BLOCKS + 1)])
    kernel = net.w["conv"].reshape(Q.STEP * Q.DIM, Q.BLOCKS, Q.FILTERS).transpose(1, 0, 2).reshape(-1, Q.FILTERS)
    assert np.allclose(top, np.maximum((spans @ kernel).max(0) + net.w["bias"], 0), atol=1e-4)


def test_odd_rows_and_labels(spark):
    docs = documents(spark, odd_rows())
    labels = spark.createDataFrame(
        [(k, k % 2, 0) for k in range(1, 11)] + [(1, 0, 0), (3, None, 0), (None, 1, 0), (77, 1, 0)],
        "doc_id bigint, quality int, toxic int")
    net = Q.fit_sample(docs, labels)
    out = Q.quality_scores(docs, net).select("row.doc_id", "score", "predicted").collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (2, 3)}) == 1
    assert {r["score"] for r in Q.quality_scores(docs, Q.fit([], [])).collect()} == {0.5}
    assert Q.quality_scores(docs.limit(0), net).count() == 0
    same = Q.fit(["a b", "c d"], [1, 1]).scores(["zz"])
    assert same[0] == pytest.approx(1, abs=1e-4)


@pytest.mark.skipif(not HAVE_TABLES, reason="no test tables")
def test_held_out_accuracy(spark):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op10_quality_classifier"](spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in quality]
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in held) >= 0.93 * len(held)
