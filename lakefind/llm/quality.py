"""Quality classifier: a convolutional network over bytes, written in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Each chunk is embedded byte by byte, 16-byte filters slide over it in steps of
4 bytes, and the chunk keeps each filter's maximum.  The maximum, mean and
minimum of these over all chunks go through one hidden layer to one
probability.  Cost and memory of scoring are proportional to the text; a long
text is scored piece by piece.

The network is fitted on the driver with Adam on a bounded sample of labelled
rows: at most ``max_rows`` rows, drawn by the hash of their id, with at most
``MAX_FIT_CHARS`` characters each (half from the start, half from the end of a
longer text).  This bounds the fit at about 40 MB whatever the corpus size;
scoring always reads whole texts.

Defined results: a null text scores like an empty one, which is a single
chunk of padding.  Rows whose label is null are not learned from; of several
labels for one id the largest counts.  Without any labelled row every score is 0.5,
and with one class the share of that class.  Rows with a null id are scored, not learned
from.  Repeated rows get equal scores; further columns are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.llm.common import id_remainder, packed, short_batches, table
from lakefind.plans.registry import query

DIM, STEP, BLOCKS, FILTERS, HIDDEN = 8, 4, 4, 32, 24
CHUNK = 256  # filter positions per chunk; neighbours share BLOCKS - 1 blocks, so no position is left out
PAD = 256
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
MAX_ROWS, MAX_FIT_CHARS = 4000, 12_000
PIECE = 1 << 16  # bytes embedded at once


class ByteNet:
    """The network's weights, its forward pass and one training step's gradients."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.w = {
            "embed": rng.normal(0, 0.5, (257, DIM)).astype(f32),
            "conv": rng.normal(0, (STEP * DIM * BLOCKS) ** -0.5, (STEP * DIM, BLOCKS * FILTERS)).astype(f32),
            "bias": np.zeros(FILTERS, f32),
            "hidden": rng.normal(0, (3 * FILTERS) ** -0.5, (3 * FILTERS, HIDDEN)).astype(f32),
            "hidden_bias": np.zeros(HIDDEN, f32),
            "out": rng.normal(0, HIDDEN ** -0.5, HIDDEN).astype(f32),
            "out_bias": np.zeros(1, f32),
        }

    @staticmethod
    def blocks(data: bytes) -> np.ndarray:
        """Bytes as rows of STEP codes, padded to a full filter at least."""
        n = max(BLOCKS, -(-len(data) // STEP))
        codes = np.full(n * STEP, PAD, np.int64)
        codes[:len(data)] = np.frombuffer(data, np.uint8)
        return codes.reshape(n, STEP)

    def chunks(self, blocks: np.ndarray, at: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each chunk's maximum of every filter, and, if asked, the positions of the maxima."""
        positions = len(blocks) - BLOCKS + 1
        tops, where = [], []
        for start in range(0, positions, CHUNK * 16):
            stop = min(positions, start + CHUNK * 16)
            x = self.w["embed"][blocks[start:stop + BLOCKS - 1]].reshape(-1, STEP * DIM)
            y = x @ self.w["conv"]
            n = stop - start
            z = y[:n, :FILTERS].copy()
            for j in range(1, BLOCKS):
                z += y[j:j + n, j * FILTERS:(j + 1) * FILTERS]
            begins = np.arange(0, n, CHUNK)
            tops.append(np.maximum.reduceat(z, begins, axis=0))
            if at:
                where += [start + b + z[b:b + CHUNK].argmax(0) for b in begins]
        top = np.maximum(np.concatenate(tops) + self.w["bias"], 0)
        return top, np.array(where) if at else None

    @staticmethod
    def pooled(top: np.ndarray) -> np.ndarray:
        return np.concatenate([top.max(0), top.mean(0), top.min(0)])

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden activations and logits for rows of pooled features."""
        h = np.maximum(features @ self.w["hidden"] + self.w["hidden_bias"], 0)
        return h, h @ self.w["out"] + self.w["out_bias"][0]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probabilities of label 1 for whole texts."""
        rows = [self.pooled(self.chunks(self.blocks(t.encode("utf-8", "replace")))[0]) for t in texts]
        logits = self.head(np.array(rows, np.float32))[1].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over some documents, given as blocks."""
        w, g = self.w, {k: np.zeros_like(v) for k, v in self.w.items()}
        seen = [self.chunks(d, at=True) for d in docs]
        features = np.array([self.pooled(top) for top, _ in seen], np.float32)
        h, logits = self.head(features)
        d_logit = ((1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) / len(docs)).astype(np.float32)
        g["out"], g["out_bias"][0] = h.T @ d_logit, d_logit.sum()
        d_h = np.outer(d_logit, w["out"]) * (h > 0)
        g["hidden"], g["hidden_bias"] = features.T @ d_h, d_h.sum(0)
        d_features = d_h @ w["hidden"].T
        lanes = np.arange(FILTERS)
        kernel = w["conv"].reshape(STEP * DIM, BLOCKS, FILTERS)
        d_kernel = g["conv"].reshape(STEP * DIM, BLOCKS, FILTERS)
        for blocks, (top, at), d in zip(docs, seen, d_features, strict=True):
            d_top = np.repeat(d[None, FILTERS:2 * FILTERS] / len(top), len(top), 0)
            d_top[top.argmax(0), lanes] += d[:FILTERS]
            d_top[top.argmin(0), lanes] += d[2 * FILTERS:]
            d_top *= top > 0
            g["bias"] += d_top.sum(0)
            for j in range(BLOCKS):  # only the positions of the maxima have a gradient
                codes = blocks[at + j]  # (chunks, filters, STEP)
                x = w["embed"][codes].reshape(*at.shape, STEP * DIM)
                d_kernel[:, j, :] += np.einsum("cfi,cf->if", x, d_top)
                d_x = d_top[:, :, None] * kernel[:, j, :].T[None]
                np.add.at(g["embed"], codes.reshape(-1), d_x.reshape(-1, DIM))
        return g


def fit(texts: list[str], labels: list[int], epochs: int = 6, batch: int = 16, rate: float = 4e-3) -> ByteNet:
    """A network fitted by Adam; the order of rows and the seed are fixed."""
    net, y = ByteNet(), np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        net.w["out"][:] = 0
        net.w["out_bias"][0] = np.log(share / (1 - share))
        return net
    docs = [net.blocks(t.encode("utf-8", "replace")) for t in texts]
    rng = np.random.default_rng(11)
    net.w["out_bias"][0] = np.log(y.mean() / (1 - y.mean()))
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    steps, total = 0, epochs * -(-len(docs) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(docs), batch):
            pick = order[lo:lo + batch]
            grad = net.gradients([docs[i] for i in pick], y[pick])
            steps += 1
            pace = rate * min(1.0, 1.5 * (1 - steps / (total + 1)))
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                lift = first[k] / (1 - 0.9 ** steps)
                net.w[k] -= pace * lift / (np.sqrt(second[k] / (1 - 0.99 ** steps)) + 1e-7)
    return net


def fit_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> ByteNet:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold, drawn by the hash of the id."""
    known = labels.select(F.col("doc_id").alias("doc"), F.col(label).cast("int").alias("y")).where(
        "doc is not null and y is not null").where(id_remainder(F.col("doc"), FOLDS) != HELD_OUT)
    known = known.groupBy("doc").agg(F.max("y").alias("y"))
    share = min(1.0, 0.9 * max_rows / max(1, known.count()))
    scale = 1 << 20
    drawn = known.where(F.pmod(F.xxhash64("doc"), F.lit(scale)) < int(share * scale)).orderBy(
        F.xxhash64("doc"), "doc").limit(max_rows)
    half = MAX_FIT_CHARS // 2
    text = F.coalesce(F.col("text"), F.lit(""))
    text = F.when(F.length(text) > MAX_FIT_CHARS, F.concat(F.left(text, F.lit(half)), F.right(text, F.lit(half)))
                  ).otherwise(text)
    # drawn has at most max_rows rows of two numbers, a proven bound for the broadcast
    rows = docs.select(F.col("doc_id").alias("doc"), text.alias("text")).join(F.broadcast(drawn), "doc")
    got = rows.toPandas().drop_duplicates("doc").sort_values("doc")
    return fit(got["text"].tolist(), got["y"].tolist())


def quality_scores(docs: DataFrame, net: ByteNet, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with its ``score`` and ``predicted`` class."""
    short_batches(docs.sparkSession)
    keyed = packed(docs, text=F.col("text"))
    schema = keyed.select("row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            score = net.scores(texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score, pa.float64())], ["row", "score"])

    return keyed.mapInArrow(run, schema).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    net = fit_sample(docs, table(spark, sf, "labels"))
    scored = quality_scores(docs, net)
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        (id_remainder(F.col("row.doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
