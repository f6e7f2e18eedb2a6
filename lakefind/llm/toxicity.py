"""Toxicity: a factorization machine over hashed terms.

A text's terms are its lower-cased words and the stems (prefixes of ``STEMS`` letters) of longer ones, each present
or not, hashed into ``2**BITS`` buckets.  The machine scores ``w0 + sum of w + sum over pairs of <v_i, v_j>`` of the
buckets present, so it can tell a pair, such as an insult next to the mention of a group, from its parts, which a
sum of weights can not.  The pair sum costs one pass over the factors: half of |sum v|^2 - sum |v|^2.

Fit: at most ``max_rows`` labelled rows outside the held-out fold, drawn by the hash of their id (the only bound; their
texts are read whole).  Tasks turn them into buckets; the driver gets at most that many lists of distinct buckets.  It
keeps the ``MAX_TERMS`` buckets that depend most on the label (log-likelihood ratio of at least ``LEAST_RATIO``) and
fits weights and factors by Adam on the regularised log loss.  Scoring is one pass over all rows with the
fitted weights (under 1 MB) and no shuffle; time is proportional to the text and memory to its distinct words.

Defined results: a null text scores like an empty one, which has no terms and gets the score of ``w0``.  Rows whose label
or id is null are not learned from; of several labels for one id the largest counts, of several texts of one id the
one with the smallest hash.  Without any labelled row every score is 0.5, and with one class the share of that class.
Repeated rows get equal scores; further columns are kept or ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.llm.common import id_remainder, packed, short_batches, table, texts
from lakefind.plans.registry import query

BITS, STEMS = 22, (3, 4, 5, 6, 7)
RANK, STEPS, RATE = 6, 300, 0.1
DECAY, FACTOR_DECAY = 2e-5, 3e-3  # of weights and of factors
MAX_TERMS, LEAST_RATIO, LEAST_ROWS = 4096, 15.0, 3
MAX_ROWS = 6000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
CACHED = 100_000  # words whose buckets a task remembers
WORD = re.compile(r"\w+")


def buckets_of(word: str) -> list[int]:
    """The buckets of a word and of its stems."""
    import xxhash

    terms = [word, *[word[:n] + "*" for n in STEMS if n < len(word)]]
    return [xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) >> (64 - BITS) for t in terms]


class Terms(dict):
    """word -> its buckets (of those the machine knows, if given), each word hashed once until there are too many."""

    def __init__(self, known: dict[int, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        own = buckets_of(word)
        self[word] = got = tuple(own if self.known is None else (self.known[b] for b in own if b in self.known))
        return got

    def of(self, text: str) -> list[int]:
        """The distinct buckets of a whole text, ascending."""
        found: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            found.update(self[word])
        return sorted(found)


def log_ratio(rows: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """How much the presence of a term and the label depend on each other (G statistic of the 2 x 2 table)."""
    total = np.zeros(len(rows))
    for seen, of_term in ((toxic, n_toxic), (rows - toxic, n - n_toxic)):
        for part, share in ((seen, rows / n), (of_term - seen, 1 - rows / n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                total += np.where(part > 0, part * np.log(part / (of_term * share)), 0)
    return 2 * total


class Machine:
    """Weights and factors of the known buckets."""

    def __init__(self, buckets: np.ndarray, bias: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.buckets = buckets
        self.w = {"bias": np.array([bias]), "weight": np.zeros(len(buckets)),
                  "factor": rng.normal(0, 0.1, (len(buckets), RANK))}

    def logits(self, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits and factor sums of rows; row i has the terms ``at[starts[i]:starts[i + 1]]``."""
        own = self.w["factor"][at]
        # a leading zero row lets empty rows be differences of running sums too
        run = np.concatenate([np.zeros((1, RANK + 2)), np.cumsum(
            np.column_stack([own, self.w["weight"][at], (own * own).sum(1)]), axis=0)])
        sums = run[starts[1:]] - run[starts[:-1]]
        factors = sums[:, :RANK]
        return self.w["bias"][0] + sums[:, RANK] + 0.5 * ((factors * factors).sum(1) - sums[:, RANK + 1]), factors

    def gradients(self, at: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss plus the decay of weights and factors."""
        logits, factors = self.logits(at, starts)
        g = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - labels) / len(labels)
        m, row = len(self.buckets), np.repeat(np.arange(len(labels)), np.diff(starts))
        weight = np.bincount(at, g[row], m)
        factor = np.column_stack([np.bincount(at, (g * factors[:, k])[row], m) for k in range(RANK)])
        factor -= self.w["factor"] * weight[:, None]
        return {"bias": np.array([g.sum()]), "weight": weight + DECAY * self.w["weight"],
                "factor": factor + FACTOR_DECAY * self.w["factor"]}

    def scores(self, rows: list[list[int]]) -> np.ndarray:
        """Probabilities of label 1 for rows of term numbers."""
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        at = np.array([t for r in rows for t in r], np.int64)
        return 1 / (1 + np.exp(-np.clip(self.logits(at, starts)[0], -30, 30)))


def fit(rows: list[np.ndarray], labels: list[int]) -> Machine:
    """A machine for rows of distinct buckets; the result depends on the rows and their order alone."""
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        return Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))))
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen, toxic = np.bincount(flat, minlength=1 << BITS), np.bincount(flat, y[row], 1 << BITS)
    often = np.flatnonzero(seen >= LEAST_ROWS)
    ratio = log_ratio(seen[often], toxic[often], len(y), y.sum())
    order = np.lexsort((often, -ratio))[:MAX_TERMS]
    machine = Machine(np.sort(often[order[ratio[order] >= LEAST_RATIO]]), float(np.log(y.mean() / (1 - y.mean()))))
    place = np.full(1 << BITS, -1, np.int64)
    place[machine.buckets] = np.arange(len(machine.buckets))
    at, row = place[flat], row[place[flat] >= 0]
    at = at[at >= 0]
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(y)))])
    first, second = ({k: np.zeros_like(v) for k, v in machine.w.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        pace = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in machine.gradients(at, starts, y).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            machine.w[k] -= pace * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return machine


def fit_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Machine:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold, drawn by the hash of the id."""
    short_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc"), F.col(label).cast("int").alias("y")).where(
        "doc is not null and y is not null").where(id_remainder(F.col("doc"), FOLDS) != HELD_OUT)
    known = known.groupBy("doc").agg(F.max("y").alias("y"))
    share = min(1.0, 0.9 * max_rows / max(1, known.count()))
    scale = 1 << 20
    drawn = known.where(F.pmod(F.xxhash64("doc"), F.lit(scale)) < int(share * scale)).orderBy(
        F.xxhash64("doc"), "doc").limit(max_rows)
    # drawn has at most max_rows rows of two numbers, a proven bound for the broadcast
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text").join(F.broadcast(drawn), "doc")
    one = rows.groupBy("doc", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            own = pa.array([terms.of(t) for t in texts(b)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("y"), own], ["doc", "y", "own"])

    got = one.mapInArrow(run, "doc bigint, y int, own array<int>").toArrow().sort_by("doc")
    own = got.column("own").combine_chunks()
    flat, ends = own.flatten().to_numpy(), np.cumsum(own.value_lengths().to_numpy())
    return fit(np.split(flat, ends[:-1]) if len(ends) else [], got.column("y").to_pylist())


def toxicity_scores(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with its ``score`` and ``predicted`` class."""
    short_batches(docs.sparkSession)
    keyed = packed(docs, text=F.col("text"))
    schema = keyed.select("row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms({int(b): k for k, b in enumerate(machine.buckets)})
        for b in batches:
            score = machine.scores([terms.of(t) for t in texts(b)])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(score, pa.float64())], ["row", "score"])

    return keyed.mapInArrow(run, schema).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, fit_sample(docs, table(spark, sf, "labels")))
    return scored.select(F.col("row.doc_id").alias("doc_id"),
                         (id_remainder(F.col("row.doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
