"""Centroid clustering by scalar lookup tables: k-means over integer vectors, exact in every round.

Vectors are cut into blocks of at most ``BLOCK`` rows and written once, dictionary-coded: for every dimension the
integers that occur in the block, and for every row the place of its integer among them.  A round tabulates the
squared difference of each dimension, occurring integer and centroid, and a row's distances are gathers from these
tables and sums.  A table has at most ``BLOCK`` entries for a dimension and centroid, however many values occur.

Scale: rows are never shuffled. A round is one pass over the written blocks; each task hands on one count and one
sum vector per centroid, which Spark adds up, and the driver sees ``k`` rows of ``dim`` sums.  The result needs one
further pass, which adds the distances per cluster, so that the rows carry them without a join.

Defined results: vectors of another length, null vectors and vectors with a null or non-finite component are left
out.  Repeated rows count each on their own, and a null vec_id is kept (it comes last in the choice of the first
centroids; rows that share an id are told apart by their integers).  With fewer than ``k`` kept vectors there are
as many centroids as vectors; without any the result is empty.  Ties go to the smaller centroid number.  An integer
beyond ``LIMIT`` raises an error: a long could not hold its distances.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakefind.llm.common import table
from lakefind.plans.registry import query
from lakefind.session import materialize

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BLOCK = 4096  # rows that share one set of tables; a place in them fits 16 bits
LIMIT = 1 << 27  # 64 squared differences of such integers stay below 2**62


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors with ``dim`` finite components."""
    inf = F.lit(float("inf"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    size = F.size("embedding") == dim
    big = F.exists("embedding", lambda x: F.abs(x.cast("double") * scale) >= LIMIT)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    error = F.raise_error(F.lit(f"a component times {scale} is beyond {LIMIT}"))
    # a null array has no length and fails the test like a wrong one
    kept = vectors.select("vec_id", "embedding").where(F.coalesce(size & sound, F.lit(False)))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(big, error).otherwise(whole).alias("v"))


class Coded:
    """One block of integer vectors: the integers that occur in each dimension, and their places per row."""

    def __init__(self, values: list[np.ndarray], codes: np.ndarray):
        self.values, self.codes = values, codes

    @classmethod
    def of(cls, rows: np.ndarray) -> Coded:
        values, codes = [], np.empty(rows.shape[::-1], np.uint16)
        for d in range(rows.shape[1]):
            own, codes[d] = np.unique(rows[:, d], return_inverse=True)
            values.append(own)
        return cls(values, codes)

    @classmethod
    def read(cls, sizes: bytes, values: bytes, codes: bytes) -> Coded:
        ends = np.cumsum(np.frombuffer(sizes, np.int32))
        own = np.split(np.frombuffer(values, np.int64), ends[:-1])
        return cls(own, np.frombuffer(codes, np.uint16).reshape(len(ends), -1))

    def written(self) -> tuple[bytes, bytes, bytes]:
        sizes = np.array([len(v) for v in self.values], np.int32)
        return sizes.tobytes(), np.concatenate(self.values).astype(np.int64).tobytes(), self.codes.tobytes()

    def distances(self, centroids: np.ndarray) -> np.ndarray:
        """Squared distances (rows, centroids), summed from one table per dimension."""
        total = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for own, at, center in zip(self.values, self.codes, centroids.T, strict=True):
            squares = (own[:, None] - center[None, :]) ** 2
            total += squares[at]
        return total

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """(k, dim) sums of the rows of each cluster."""
        out = np.zeros((k, len(self.values)), np.int64)
        for d, (own, at) in enumerate(zip(self.values, self.codes, strict=True)):
            n = np.bincount(cluster * len(own) + at, minlength=k * len(own)).reshape(k, len(own))
            out[:, d] = n @ own
        return out


def coded_blocks(vectors: DataFrame, dim: int) -> DataFrame:
    """Written blocks (ids, sizes, values, codes) of ``vectors`` (vec_id, v)."""

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column("vec_id") for b in held])
        rows = np.concatenate([b.column("v").flatten().to_numpy().reshape(-1, dim) for b in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids.to_pylist()], pa.list_(pa.int64())),
             *[pa.array([x], pa.binary()) for x in Coded.of(rows).written()]], ["ids", "sizes", "values", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, BLOCK - n))
                n += held[-1].num_rows
                b = b.slice(held[-1].num_rows)
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return materialize(vectors.mapInArrow(run, "ids array<bigint>, sizes binary, values binary, codes binary"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Coded]]:
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("sizes", "values", "codes")]
        for k, parts in enumerate(zip(*columns, strict=True)):
            yield b.column("ids").slice(k, 1).flatten(), Coded.read(*parts)


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(name.asc_nulls_last(), "v").limit(k).select("v").toPandas()["v"]
    return np.array([list(v) for v in first], np.int64)


def _tallies(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """cluster -> (rows, distance sum, component sums), for the clusters that have rows."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, block in _blocks(batches):
            d = block.distances(centroids)
            cluster = d.argmin(1)
            n += np.bincount(cluster, minlength=k)
            np.add.at(far, cluster, d[np.arange(len(d)), cluster])
            sums += block.sums(cluster, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array(far),
             pa.ListArray.from_arrays(np.arange(k + 1, dtype=np.int32) * dim, pa.array(sums.ravel()))],
            ["cluster", "n", "far", "sums"])

    def whole(c: str | Column) -> Column:  # sums over all tasks may pass a long
        return F.sum(F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)"))

    parts = blocks.mapInArrow(run, "cluster int, n bigint, far bigint, sums array<bigint>").where("n > 0")
    rows = parts.groupBy("cluster").agg(
        whole("n"), whole("far"), *[whole(F.col("sums")[d]) for d in range(dim)]).collect()  # k rows
    return {r[0]: (int(r[1]), int(r[2]), [int(x) for x in r[3:]]) for r in rows}


def fit(blocks: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds; one without vectors stays where it is."""
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (n, _, sums) in _tallies(blocks, centroids).items():
            centroids[c] = [s // n for s in sums]  # floor, of exact integers
    return centroids


def cluster_vectors(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM,
                    scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    schema = ("vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
              "centroid_sha256 string")
    kept = integers(vectors, dim, scale)
    start = first_centroids(kept, k, seed)
    if not len(start):
        return vectors.sparkSession.createDataFrame([], schema)
    blocks = coded_blocks(kept, dim)
    centroids = fit(blocks, start, rounds)
    own = np.zeros(len(centroids), object)
    for c, (_, far, _) in _tallies(blocks, centroids).items():
        own[c] = far
    whole = int(own.sum())
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches):
            d = block.distances(centroids)
            cluster = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(d[np.arange(len(d)), cluster]),
                 pa.array([own[c] for c in cluster], pa.int64()), pa.array([whole] * len(d), pa.int64()),
                 pa.array([names[c] for c in cluster])],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(run, schema)


_STEP = """
far{r} AS MATERIALIZED (SELECT row, k, sum((v - c) * (v - c)) AS s FROM comps JOIN cent{r} USING (d) GROUP BY row, k),
near{r} AS MATERIALIZED (SELECT row, k, s FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY s, k) AS o FROM far{r}) WHERE o = 1)"""
_MOVE = """
sums{r} AS (SELECT k, d, CAST(sum(v) AS BIGINT) AS t, count(*) AS n FROM comps JOIN near{r} USING (row) GROUP BY k, d),
cent{s} AS MATERIALIZED (SELECT p.k, p.d, coalesce((t - ((t % n) + n) % n) // n, c) AS c FROM cent{r} p LEFT JOIN sums{r} q
  ON p.k = q.k AND p.d = q.d)"""


def _sql() -> str:
    """All rounds written out, one after another."""
    parts = [f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, embedding::DOUBLE[] AS e
  FROM embeddings WHERE len(embedding) = {DIM} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
comps AS MATERIALIZED (SELECT row, unnest(range(1, {DIM + 1})) AS d, CAST(unnest(list_transform(e, lambda x: floor({SCALE} * x))) AS BIGINT) AS v
  FROM kept),
seeds AS (SELECT row, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), row) - 1 AS k FROM kept),
cent0 AS MATERIALIZED (SELECT k, d, v AS c FROM comps JOIN (SELECT * FROM seeds WHERE k < {CLUSTERS}) USING (row))"""]
    for r in range(ROUNDS):
        parts += [_STEP.format(r=r), _MOVE.format(r=r, s=r + 1)]
    parts.append(_STEP.format(r=ROUNDS))
    parts.append(f"""
names AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS name FROM cent{ROUNDS} GROUP BY k)""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, CAST(sum(s) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(s) OVER () AS BIGINT) AS inertia, name AS centroid_sha256 FROM near{ROUNDS} JOIN kept USING (row) JOIN names USING (k)"""


@query("op13_centroid_clustering", _sql())
def op13_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return cluster_vectors(table(spark, sf, "embeddings"))
